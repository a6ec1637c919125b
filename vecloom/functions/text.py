"""Expressions on the lines of element and word files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(line: Column) -> Column:
    """The text of a line that is one JSON string; null for anything else that cannot be read."""
    return F.get_json_object(line, "$")


def json_line(text: Column) -> Column:
    """A text as one JSON string."""
    return F.regexp_extract(F.to_json(F.named_struct(F.lit("v"), text)), r'(?s)^\{"v":(.*)\}$', 1)


def after_last_colon(text: Column) -> Column:
    return F.substring_index(text, ":", -1)


def words(text: Column) -> Column:
    """The words between blanks of any kind, none of them empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_of_line(line: Column) -> Column:
    """The first field of a line of token and numbers."""
    return F.element_at(F.split(F.trim(line), r"\s+"), 1)


def vector_of_line(line: Column) -> Column:
    """The numbers of a line of token and numbers."""
    fields = F.split(F.trim(line), r"\s+")
    return F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))).cast("array<float>")


def shard_path(path: str, shard: int) -> str:
    """The file of one shard: ``elements-{i}.bin`` in a directory, else the number before the suffix (``bin`` if there is none)."""
    import os

    if os.path.isdir(path):
        return os.path.join(path, f"elements-{shard}.bin")
    stem, suffix = os.path.splitext(path)
    return f"{stem}-{shard}{suffix or '.bin'}"
