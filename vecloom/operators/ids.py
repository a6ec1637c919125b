"""Contiguous ids, shards of contiguous ids, and appending."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import checkpointed


def numbered(df: DataFrame, id_col: str, start: int = 0, by: str | list[str] | None = None) -> DataFrame:
    """The rows with contiguous ids from ``start``, in the order of ``by`` (or as they come).

    Each partition counts its rows; the offsets, one per partition, are added up. No task sees
    more than its partition.
    """
    by = [by] if isinstance(by, str) else by
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    fixed = checkpointed(rows.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    counts = {r["p"]: r["n"] for r in fixed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offset, pairs = start, []
    for p in sorted(counts):
        pairs.append((p, offset))
        offset += counts[p]
    if not pairs:
        return fixed.drop("__place").withColumn(id_col, F.lit(start).cast("long"))
    offsets = fixed.sparkSession.createDataFrame(pairs, "__part long, __offset long")
    joined = fixed.join(F.broadcast(offsets), part == F.col("__part"))
    return joined.withColumn(id_col, F.col("__offset") + F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place", "__part", "__offset")


def concatenated(first: DataFrame, second: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Both collections, the ids of the second moved behind those of the first. Vectors of different lengths raise an error."""
    a, b = (d.agg(F.min(F.size(vec_col)), F.max(F.size(vec_col)), F.max(id_col)).first() for d in (first, second))
    widths = {w for w in (a[0], a[1], b[0], b[1]) if w is not None}
    if len(widths) > 1:
        raise ValueError("vectors of different lengths")
    shift = 0 if a[2] is None else a[2] + 1
    return first.select(id_col, vec_col).unionByName(second.select((F.col(id_col) + shift).alias(id_col), vec_col))


def shard_of(df: DataFrame, id_col: str, n: int, shards: int) -> DataFrame:
    """The rows with ``shard``: contiguous ranges of ids 0 to n - 1, each of ``ceil(n / shards)``."""
    if shards < 1:
        raise ValueError("at least one shard")
    return df.withColumn("shard", F.floor(F.col(id_col) / F.lit(max(1, math.ceil(n / shards)))).cast("int"))


def row_range(df: DataFrame, id_col: str, begin: int, end: int) -> DataFrame:
    """The rows with ids from ``begin`` up to but not including ``end``, renumbered from 0."""
    return df.where((F.col(id_col) >= begin) & (F.col(id_col) < end)).withColumn(id_col, F.col(id_col) - begin)
