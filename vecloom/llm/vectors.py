"""Vectors between DataFrames and NumPy, shared by the operators on vectors.

A vector takes part if its id is not null, it has the table's dimension, no component is null,
NaN or infinite and not all are zero; all are scaled to unit length, so that
1 - (inner product) is the angular distance. The dimension is the most frequent length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import spread

ROWS = 4096


def selected(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)``."""
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id is not null and size(vec) > 0"))


def dimension_and_count(vectors: DataFrame) -> tuple[int, int]:
    """The most frequent length (the greatest of several) and the number of rows that have it; (0, 0) for none."""
    top = vectors.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return (top["dim"], top["n"]) if top else (0, 0)


def unit_rows(ids: pa.Array, vecs: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and unit vectors of the rows that take part."""
    fits = pc.equal(pc.list_value_length(vecs), dim).to_numpy(zero_copy_only=False)
    if not fits.all():
        keep = pa.array(fits)
        ids, vecs = ids.filter(keep), vecs.filter(keep)
    if not len(ids):
        return np.empty(0, "i8"), np.empty((0, dim), "f4")
    x = vecs.flatten().to_numpy(zero_copy_only=False).astype("f4", copy=False).reshape(-1, dim)
    wide = x.astype("f8")
    norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    good = np.isfinite(norm) & (norm > 0)
    return ids.to_numpy()[good], (wide[good] / norm[good, None]).astype("f4")


def per_rows(work: Callable[[np.ndarray, np.ndarray], pa.RecordBatch | None], dim: int, end: Callable[[], pa.RecordBatch | None] | None = None):
    """A function for ``mapInArrow`` over ``(id, vec)`` that calls ``work(ids, unit vectors)`` for some thousand rows at a time, and ``end`` at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, x = unit_rows(part.column(0), part.column(1), dim)
                if len(ids) and (out := work(ids, x)) is not None and out.num_rows:
                    yield out
        if end and (out := end()) is not None:
            yield out

    return run


def hashed_unit(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each id, the same on every run."""
    h = (ids.astype("u8") + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype("f8") / float(1 << 53)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def hashed_features(df: DataFrame, id_col: str, terms_col: str, dim: int = 256) -> DataFrame:
    """``(id, vec)`` of records of terms: hashed TF-IDF features.

    Each term falls on one of ``dim`` places with a sign, both by its hash; its weight is its
    occurrences times the logarithm of the inverse document frequency over all records.
    Records without terms have no vector. Repeated ids count once (the greatest list).
    """
    records = df.select(F.col(id_col).cast("long").alias("id"), F.col(terms_col).alias("terms")).where("id is not null").groupBy("id").agg(F.max("terms").alias("terms"))
    counts = records.select("id", F.explode("terms").alias("term")).where("term is not null").groupBy("id", "term").agg(F.count("*").alias("n"))
    total = records.agg(F.count("*").alias("n")).scalar()
    idf = counts.groupBy(F.col("term").alias("of")).agg(F.log(total / F.count("*").cast("double")).alias("idf"))
    places = counts.join(idf, F.col("term") == F.col("of")).select(
        "id",
        F.pmod(F.xxhash64("term"), F.lit(dim)).cast("int").alias("place"),
        (F.col("n") * F.col("idf") * F.when(F.pmod(F.hash("term"), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("w"),
    )
    summed = places.groupBy("id", "place").agg(F.sum("w").alias("w")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"))
    return summed.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("vec"))
