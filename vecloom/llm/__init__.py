"""Operators that prepare training data at scale. Nothing outside this package imports it."""
