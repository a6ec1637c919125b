"""Readers and writers of vectors, words and elements.

Parquet is the native format. Besides it: text files of words and elements (one JSON string per
line, gzip or not), files of tokens with vectors, and flat binary files of vectors (an 8-byte
little-endian width before the numbers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions import vector as V
from vecloom.operators.ids import numbered, row_range, shard_of


def vectors(spark: SparkSession, path: str, kind: str = "angular", id_col: str = "id", vec_col: str = "vec", raw: bool = False) -> DataFrame:
    """``(id, vec)`` from parquet: normalized (``angular``), quantized (``angular_int``), or ``raw`` as stored."""
    df = spark.read.parquet(path).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    if raw:
        return df
    return df.withColumn("vec", V.quantize(F.col("vec")) if kind == "angular_int" else V.normalize(F.col("vec")).cast("array<float>"))


def flat_vectors(flat: DataFrame, flat_col: str, dim: int) -> DataFrame:
    """``(id, vec)`` out of one long array per row, cut into vectors of ``dim``; the length must be a multiple of it."""
    if dim < 1:
        raise ValueError("the dimension must be at least 1")
    n = F.size(flat_col)
    sound = F.when(n % dim == 0, (n / dim).cast("int")).otherwise(F.raise_error(F.lit("length is no multiple of the dimension")).cast("int"))
    places = F.when(sound > 0, F.sequence(F.lit(0), sound - 1)).otherwise(F.array().cast("array<int>"))
    return flat.select(F.col(flat_col).alias("flat"), F.explode(places).alias("i")).select(F.col("i").cast("long").alias("id"), F.slice("flat", F.col("i") * dim + 1, F.lit(dim)).alias("vec"))


def binary_vectors(spark: SparkSession, path: str, dtype: str = "float") -> DataFrame:
    """``(id, vec)`` from flat binary files, in the order of their paths; ``dtype`` is ``float`` or ``tinyint``.

    A width of 0 or a ragged end raises an error. Only the listing of files is on the driver;
    each file is read by its task.
    """
    kind = {"float": "<f4", "tinyint": "i1"}[dtype]
    arrow = pa.float32() if dtype == "float" else pa.int8()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                width = int.from_bytes(content[:8], "little") if len(content) >= 8 else 0
                body = np.frombuffer(content, kind, offset=8) if width else None
                if body is None or len(body) % width:
                    raise ValueError(f"no file of vectors: {path}")
                for at in range(0, len(body) // width, 65536):
                    rows = body[at * width : (at + 65536) * width]
                    n = len(rows) // width
                    yield pa.record_batch([pa.array([path] * n), pa.array(np.arange(at, at + n)), pa.FixedSizeListArray.from_arrays(pa.array(rows, arrow), width).cast(pa.list_(arrow))], names=["path", "row", "vec"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, row long, vec array<{dtype}>")
    return numbered(rows, "id", 0, ["path", "row"]).select("id", "vec")


def write_binary_vectors(df: DataFrame, path: str, dtype: str = "float", id_col: str = "id", vec_col: str = "vec") -> None:
    """Writes a flat binary file of the vectors in order of id, streamed through the driver partition by partition (an export format)."""
    kind = {"float": "<f4", "tinyint": "i1"}[dtype]
    width = None
    with open(path, "wb") as f:
        for r in df.orderBy(id_col).select(vec_col).toLocalIterator():
            v = np.asarray(r[0], kind)
            if width is None:
                width = len(v)
                f.write(width.to_bytes(8, "little"))
            if len(v) != width:
                raise ValueError("vectors of different lengths")
            f.write(v.tobytes())


def token_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(id, token, vec)`` from lines of a token and numbers, normalized; ids in the order of file and line."""
    lines = _lines(spark, path)
    return lines.where(F.trim("value") != "").select("id", T.token_of_line(F.col("value")).alias("token"), V.normalize(T.vector_of_line(F.col("value"))).cast("array<float>").alias("vec"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(id, value)``: the lines of a file or of all files of a directory, in order of path and line; gzip by suffix."""
    # splits of large files are read by different tasks: lines are in the order of path, split and place within it
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
    placed = lines.withColumn("line", F.monotonically_increasing_id())
    return numbered(placed, "id", 0, ["path", "split", "line"]).select("id", F.regexp_replace("value", r"\r$", "").alias("value"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """``(word_id, word)``: one JSON string per line, the id is the line's number. A line that is none raises an error."""
    read = _lines(spark, path).where("value <> ''")
    word = F.coalesce(T.json_text(F.col("value")), F.raise_error(F.lit("a line that is no JSON string")).cast("string"))
    return read.select(F.col("id").cast("int").alias("word_id"), word.alias("word"))


def element_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(id, value)`` of element files."""
    return _lines(spark, path)


def write_words(df: DataFrame, path: str) -> None:
    """One JSON string per line in order of id."""
    df.repartitionByRange(1, "word_id").sortWithinPartitions("word_id").select(T.json_line(F.col("word")).alias("value")).write.mode("overwrite").text(path)


def write_shards(df: DataFrame, path: str, shards: int, n: int | None = None, id_col: str = "id") -> int:
    """Writes contiguous ranges of ids as parquet partitions ``shard=i``; the number of rows."""
    n = df.count() if n is None else n
    shard_of(df, id_col, n, shards).write.mode("overwrite").partitionBy("shard").parquet(path)
    return n


def write_range(df: DataFrame, path: str, begin: int, end: int, id_col: str = "id") -> None:
    """Writes the rows of a range of ids, renumbered from 0."""
    row_range(df, id_col, begin, end).write.mode("overwrite").parquet(path)


def write_filtered(df: DataFrame, path: str, list_col: str, predicate, ordered: bool = False) -> None:
    """Writes the rows with only those list entries that fulfil the predicate (a function of a column), ordered if asked."""
    kept = F.filter(F.col(list_col), predicate)
    df.withColumn(list_col, F.array_sort(kept) if ordered else kept).write.mode("overwrite").parquet(path)
