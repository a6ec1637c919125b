"""Vecloom: vector search and embedding pipelines on PySpark DataFrames."""

__version__ = "0.1.0"
