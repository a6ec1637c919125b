"""Frequency of every distinct term, from a vertical layout of bitmaps.

The records are divided by id into chunks of 32,768 consecutive ids. One shuffle brings the
records of a chunk together (rows delivered twice meet there and are counted once), so that
every chunk builds, for each of its terms, one container of record positions and one counter
of occurrences without another exchange. A container is a sorted list of positions while it
is short and a bitmap of 4 KB beyond that. Containers of different chunks never overlap, so
their union is the set of all of them and a term's document frequency is the sum of their
cardinalities. Chunks are bounded by their id range: a term that is in a third of all
records is spread over all chunks, and what is shuffled by term is one short row a chunk.

Nulls: a null id is no record; a null or empty list is a record without terms (it counts in
the total); null terms within a list are dropped. Rows that share an id but differ: the
greatest list counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_IDS = 32768
#: Positions up to which a list takes less room than a bitmap of CHUNK_IDS bits (2 bytes each).
SPARSE_LIMIT = CHUNK_IDS // 8 // 2


def chunked_records(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """``(chunk, bit, terms)``, one row per id, partitioned by chunk."""
    rows = df.select(F.col(id_col).cast("long").alias("rec"), F.col(list_col).alias("terms")).where("rec is not null")
    rows = rows.withColumn("chunk", F.shiftright("rec", 15)).repartition("chunk")
    return (
        rows.groupBy("chunk", "rec")
        .agg(F.max("terms").alias("terms"))
        .select("chunk", F.pmod("rec", F.lit(CHUNK_IDS)).cast("int").alias("bit"), "terms")
    )


def term_bitmaps(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """The vertical layout: ``(term, chunk, positions ARRAY<INT> | bitmap BINARY, docs, occurrences)``.

    Exactly one of ``positions`` and ``bitmap`` is set.
    """
    postings = (
        chunked_records(df, id_col, list_col)
        .select("chunk", "bit", F.explode("terms").alias("term"))
        .where("term is not null")
        .groupBy("chunk", "term", "bit")
        .agg(F.count("*").alias("n"))
    )
    built = postings.groupBy("chunk", "term").agg(
        F.bitmap_construct_agg("bit").alias("all_bits"),
        F.collect_list("bit").alias("listed"),
        F.sum("n").alias("occurrences"),
    )
    sparse = F.size("listed") <= SPARSE_LIMIT
    return built.select(
        "term",
        "chunk",
        F.when(sparse, F.array_sort("listed")).alias("positions"),
        F.when(~sparse, F.col("all_bits")).alias("bitmap"),
        F.when(sparse, F.size("listed")).otherwise(F.bitmap_count("all_bits")).cast("long").alias("docs"),
        "occurrences",
    )


def union_bitmaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two vertical layouts over disjoint sets of records (an increment): containers of one term and chunk are merged."""
    rows = a.unionByName(b)
    listed = rows.where("positions is not null").select("term", "chunk", F.explode("positions").alias("bit")).groupBy("term", "chunk").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    dense = rows.where("bitmap is not null").select("term", "chunk", "bitmap")
    merged = dense.unionByName(listed).groupBy("term", "chunk").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    occurrences = rows.groupBy("term", "chunk").agg(F.sum("occurrences").alias("occurrences"))
    return merged.join(occurrences, ["term", "chunk"]).select("term", "chunk", F.lit(None).cast("array<int>").alias("positions"), "bitmap", F.bitmap_count("bitmap").alias("docs"), "occurrences")


def frequencies(layout: DataFrame) -> DataFrame:
    """``(term, docs, occurrences)``: document frequency from the containers' cardinalities."""
    return layout.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))


def record_count(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """``(total)``: distinct ids, those without terms included, in one row."""
    per_chunk = chunked_records(df, id_col, list_col).groupBy("chunk").agg(F.bitmap_count(F.bitmap_construct_agg("bit")).alias("n"))
    return per_chunk.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


def term_frequencies(df: DataFrame, id_col: str, list_col: str, rare_max: int = 2, common_share: float = 0.1) -> DataFrame:
    """``(term, docs, occurrences, mark)``; mark is ``'rare'`` up to ``rare_max`` records, ``'common'`` above ``common_share`` of all, else null.

    A term that is both (a tiny collection) is ``'rare'``.
    """
    total = record_count(df, id_col, list_col).scalar()
    mark = F.when(F.col("docs") <= rare_max, "rare").when(F.col("docs") > F.lit(common_share) * total, "common")
    return frequencies(term_bitmaps(df, id_col, list_col)).withColumn("mark", mark)


def word_frequencies(terms: DataFrame, words: DataFrame, **marks) -> DataFrame:
    """``(word_id, word, docs, occurrences, mark)`` for every term of ``terms(id, term_ids)``; word is null for ids without an entry.

    An id with several words takes the smallest.
    """
    entries = words.where("word_id is not null").groupBy(F.col("word_id").alias("entry_id")).agg(F.min("word").alias("word"), F.lit(True).alias("known"))
    counted = term_frequencies(terms, "id", "term_ids", **marks)
    return counted.join(entries, F.col("term") == F.col("entry_id"), "left").select(
        F.col("term").alias("word_id"), "word", "docs", "occurrences", "mark", F.coalesce("known", F.lit(False)).alias("known")
    )
