"""Records that differ only in format: one kept record per set, and the number of its copies.

Each record gets a canonical key (below). The records are range-partitioned and sorted, with
spilling, by (key, id); a streaming scan compares each key in full with the one before and
numbers the runs. Because the id is part of the range, a key held by a third of all records
spreads over many partitions: a run that crosses partitions is stitched together afterwards
from two boundary rows per partition (their number does not grow with the records), each of which
carries the run's first id. The scan emits ids only; texts are shuffled once.

Canonical keys
 - id lists: the ids in order of size, each as often as it occurs;
 - texts: letter case dropped, ASCII blanks taken as gaps, ASCII punctuation at the edges of
   words or standing alone dropped, the words in order, each as often as it occurs;
 - lines: the text after the last colon of the decoded JSON string, then as texts.
All other characters count. Nulls, empty lists, texts without a word and lines that are not
one valid JSON string have no key and belong to no set; null ids are no records. Rows that
share id and key count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.session import checkpointed, spread

_GAP = r"[ \t\n\x0B\f\r]+"
_EDGE = r"(?<![^ \t\n\x0B\f\r])\p{Punct}+|\p{Punct}+(?![^ \t\n\x0B\f\r])"
_ESCAPE = r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'
_PLAIN_STRING = r'^[ \t\r\n]*"[^"\\\x00-\x1F]*"[ \t\r\n]*$'


def list_key(ids: Column) -> Column:
    """The key of a list of ids, null for null and empty lists (null elements dropped)."""
    kept = F.filter(ids, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(F.array_sort(kept), ","))


def text_key(text: Column) -> Column:
    """The key of a text, null if it holds no word. Words are joined by blanks, which no word contains."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), _EDGE, ""), _GAP), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.array_sort(words), " "))


def decoded_line(value: Column) -> Column:
    """The text of one JSON string, null unless the line is exactly that."""
    valid = F.regexp_replace(value, _ESCAPE, "").rlike(_PLAIN_STRING)
    return F.when(valid, F.get_json_object(value, "$"))


def line_key(value: Column) -> Column:
    """The key of an element line: its text after the last colon."""
    return text_key(F.substring_index(decoded_line(value), ":", -1))


def keyed_records(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``(id, key)`` of the records that have a key."""
    rows = spread(df.where(F.col(id_col).isNotNull()))
    return rows.select(F.col(id_col).cast("long").alias("id"), key.alias("key")).where("id is not null and key is not null")


_SCAN = "part int, first boolean, last boolean, kept long, id long, key binary"


def _rows(part: int, first, last, kept, ids, keys) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(np.full(len(kept), part, "i4")), pa.array(first, pa.bool_()), pa.array(last, pa.bool_()), pa.array(kept, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary())],
        names=["part", "first", "last", "kept", "id", "key"],
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads one sorted partition; every row that is not the first of its run comes out with the run's first id.

    Rows without ``id`` describe the runs at the partition's two ends, with the full key, so
    that neighbours can be compared.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first_key = first_id = run_key = run_id = last_id = None
    runs = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, ids = batch.column("key").cast(pa.large_binary()), batch.column("id").to_numpy()
        if first_key is None:
            first_key, first_id = keys[0].as_py(), int(ids[0])
        same = np.zeros(n, bool)
        same[0] = runs > 0 and keys[0].as_py() == run_key
        if n > 1:
            same[1:] = pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        before = np.concatenate([[ids[0] if last_id is None else last_id], ids[:-1]])
        starts = np.flatnonzero(~same)
        run_of = np.cumsum(~same)  # 0: the run that the batch before ended with
        kept = np.concatenate([[run_id or 0], ids[starts]])[run_of]
        out = same & (ids != before)  # an equal id: one record delivered twice
        if m := int(out.sum()):
            yield _rows(part, run_of[out] + runs <= 1, np.zeros(m, bool), kept[out], ids[out], [None] * m)
        runs += len(starts)
        run_key, run_id, last_id = keys[n - 1].as_py(), int(kept[-1]), int(ids[-1])
    if runs == 1:
        yield _rows(part, [True], [True], [run_id], [None], [run_key])
    elif runs:
        yield _rows(part, [True, False], [False, True], [first_id, run_id], [None, None], [first_key, run_key])


def _stitched(ends: list) -> list[tuple[int, int, int]]:
    """``(part, start, bridge)`` of the partitions whose first run began earlier: the id it began with, and the id its own part began with (a copy of it)."""
    fixes = []
    start, key, at = None, None, None
    for e in ends:
        if e["first"] and key is not None and bytes(e["key"]) == key:
            fixes.append((e["part"], start, e["kept"]))
            if e["last"]:
                continue  # the run goes on
        if e["last"]:
            start, key = e["kept"], bytes(e["key"])
        elif not e["first"]:
            start, key = None, None
    return fixes


def copies_of(keyed: DataFrame) -> DataFrame:
    """``(kept_id, copy_id)`` for ``(id, key)``: in each set of equal keys the smallest id is kept and every other is its copy."""
    spark = keyed.sparkSession
    # the ranges come from a sample of the keys: written down, they are made once and not for the sample too
    written = checkpointed(keyed.select("id", F.col("key").cast("binary").alias("key")))
    ordered = written.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    scanned = checkpointed(ordered.mapInArrow(_scan, _SCAN))
    # two rows per partition at most: bounded by the number of partitions
    ends = scanned.where("id is null").select("part", "first", "last", "kept", "key").orderBy("part", F.desc("first")).collect()
    fixes = _stitched(ends)
    rows = scanned.where("id is not null").select("part", "first", "kept", "id")
    if not fixes:
        return rows.select(F.col("kept").alias("kept_id"), F.col("id").alias("copy_id"))
    fixed = spark.createDataFrame(fixes, "fix_part int, start long, bridge long")
    inner = rows.join(F.broadcast(fixed.select("fix_part", "start")), (F.col("part") == F.col("fix_part")) & F.col("first"), "left").select(
        F.coalesce("start", "kept").alias("kept_id"), F.col("id").alias("copy_id")
    )
    return inner.unionByName(fixed.select(F.col("start").alias("kept_id"), F.col("bridge").alias("copy_id")))


def kept_with_counts(keyed: DataFrame) -> DataFrame:
    """``(kept_id, copies)`` for every set, those of one record included: ``copies`` counts the other records of the set."""
    pairs = copies_of(keyed)
    counts = pairs.groupBy("kept_id").agg(F.count("*").alias("copies"))
    singles = keyed.select("id").distinct().join(pairs.select(F.col("copy_id").alias("id")), "id", "left_anti")
    return singles.join(counts, F.col("id") == F.col("kept_id"), "left").select(F.col("id").alias("kept_id"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))
