"""Exact nearest neighbours, and graphs of them.

A task multiplies its queries with a part of the elements, tile by tile, and keeps the best of each query, and the partial
results are merged: a partial and a final top k, and no pair of rows is ever materialized. A query set of no
more than ``QUERY_BYTES`` is sent to all tasks; a larger one stays distributed: blocks of
queries and parts of the elements meet in one task for each pair of them. Vectors of any length are compared by
their cosine, a zero vector has distance 1 to everything; ties are ordered by id.
Null ids and vectors take no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vector as V
from vecloom.session import default_parallelism, spread

#: Queries that are sent to all tasks without being counted.
QUERY_BLOCK = 8192
#: Bytes of the vectors and lists of the queries that a task holds: more queries than that are divided into blocks.
QUERY_BYTES = 64 << 20
#: Queries and elements of a tile, and elements after which lists are brought up to date, at first and at most.
TILE, CHUNK, FIRST, STEP = 256, 2048, 64, 16384
#: Numbers of the vectors that are gathered at once.
GATHERED = 1 << 22
#: Decimals at which distances are compared: equal vectors tie, whatever the order of addition.
DIGITS = 9


def matrix(vecs: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix in double precision; lengths that differ raise an error."""
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False)
    if len(flat) != len(vecs) * dim:
        raise ValueError("vectors of different lengths")
    return flat.reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def asked(queries: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` of the queries that are not null."""
    return queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")


def _held(queries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of ``(id, vec)``."""
    vecs = queries.column("vec").combine_chunks()
    vecs = pa.concat_arrays(vecs.chunks) if isinstance(vecs, pa.ChunkedArray) else vecs
    return queries.column("id").to_numpy(), matrix(vecs, len(vecs[0])) if queries.num_rows else np.empty((0, 0))


def cosine_distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Queries x elements: 1 - cosine, 0 at least."""
    return np.maximum(0, 1 - unit(q) @ unit(x).T)


class _Best:
    """The k nearest of the elements so far for each query, by (distance, id).

    Cosines are worked out in single precision first; what may be among the k nearest, with the greatest
    error that such a cosine can have, is compared in double precision.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] | None):
        self.ids, self.k, self.exclude_self, self.distance = ids, k, exclude_self, distance
        self.q = q if distance else unit(q)
        self.screen = None if distance else self.q.astype("f4")
        self.blind = np.zeros(len(q), bool) if distance else ~q.any(axis=1)
        self.slack = (q.shape[1] + 8) * 2.0**-23 + 10.0 ** (1 - DIGITS)
        self.d = np.full((len(q), k), np.inf)
        self.i = np.full((len(q), k), np.iinfo("i8").max)
        self.seen = 0
        self.cosine, self.passed = np.empty(TILE * CHUNK, "f4"), np.empty(TILE * CHUNK, bool)  # written to again and again

    def add(self, own: np.ndarray, x: np.ndarray) -> None:
        x = x if self.distance else unit(x)
        while len(own):
            n = min(max(FIRST, self.seen), STEP)  # few at first: the limits are not yet narrow
            some, at = x[:n], own[:n]
            screen = None if self.distance else some.astype("f4")
            for low in range(0, len(self.ids), TILE):
                self._tile(slice(low, low + TILE), at, some, screen)
            self.seen += len(at)
            own, x = own[n:], x[n:]

    def _tile(self, rows: slice, own: np.ndarray, x: np.ndarray, screen: np.ndarray | None) -> None:
        last, last_id = self.d[rows, -1], self.i[rows, -1]
        # a query without direction is as far from everything: only smaller ids matter
        floor = np.where(self.blind[rows] & (own.min() > last_id), np.inf, 1 - last - self.slack).astype("f4")[:, None]
        found = []
        for at in range(0, len(own), CHUNK):
            part = slice(at, at + CHUNK)
            if self.distance:
                near = np.round(self.distance(self.q[rows], x[part]), DIGITS)
                r, c = np.divmod(_true(near <= last[:, None]), near.shape[1])
                dist = near[r, c]
            else:
                r, c, dist = self._screened(rows, x[part], screen[part], floor)
            ids = own[at + c]
            better = (dist < last[r]) | ((dist == last[r]) & (ids < last_id[r]))
            if self.exclude_self:
                better &= ids != self.ids[rows][r]
            if better.any():
                found.append((r[better], dist[better], ids[better]))
        if found:
            self._keep(rows, *(np.concatenate(a) for a in zip(*found, strict=True)))

    def _screened(self, rows: slice, x: np.ndarray, screen: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries and elements that may be near, by place, and their distances."""
        q = self.q[rows]
        shape = len(q), len(x)
        cosine, passed = (a[: shape[0] * shape[1]].reshape(shape) for a in (self.cosine, self.passed))
        np.matmul(self.screen[rows], screen.T, out=cosine)
        flat = _true(np.greater_equal(cosine, floor, out=passed))
        r, c = np.divmod(flat, cosine.shape[1])
        if len(flat) > cosine.size // 16:
            exact = (q @ x.T).ravel()[flat]
        else:
            step = max(1, GATHERED // max(1, q.shape[1]))
            exact = np.concatenate([np.einsum("ij,ij->i", q[r[a : a + step]], x[c[a : a + step]]) for a in range(0, max(1, len(flat)), step)])
        return r, c, np.round(np.maximum(0, 1 - exact), DIGITS)

    def _keep(self, rows: slice, r: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        changed, place = np.unique(r, return_inverse=True)
        d, i = self.d[rows], self.i[rows]  # views
        place = np.concatenate([np.repeat(np.arange(len(changed)), self.k), place])
        dist, ids = np.concatenate([d[changed].ravel(), dist]), np.concatenate([i[changed].ravel(), ids])
        order = np.lexsort((ids, dist, place))
        start = np.searchsorted(place[order], np.arange(len(changed)))
        best = order[start[:, None] + np.arange(self.k)]
        d[changed], i[changed] = dist[best], ids[best]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), QUERY_BLOCK):
            d, i = self.d[at : at + QUERY_BLOCK], self.i[at : at + QUERY_BLOCK]
            good = np.isfinite(d)
            if good.any():
                yield pa.record_batch([pa.array(np.broadcast_to(self.ids[at : at + QUERY_BLOCK, None], d.shape)[good]), pa.array(i[good]), pa.array(d[good])], names=["query_id", "id", "dist"])


def _true(mask: np.ndarray) -> np.ndarray:
    """Places in the flat mask that are true, few of them: eight at a time."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view("u8"))
    a, b = np.nonzero(flat.reshape(-1, 8)[some])
    return some[a] * 8 + b


def _partial(asked_of: Callable[[], tuple[np.ndarray, np.ndarray]], k: int, exclude_self: bool, distance: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    own_distance = None if distance is cosine_distance else distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            best = best or _Best(*asked_of(), k, exclude_self, own_distance)
            best.add(b.column(0).to_numpy(), matrix(b.column(1), best.q.shape[1]))
        if best:
            yield from best.rows()

    return run


def merged_top(partial: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, dist)``: the k best by (distance, id) of partial results."""
    best = partial.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "id"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("rank", "e")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("id"), F.col("e.dist").alias("dist"))


def knn(queries: DataFrame, elements: DataFrame, k: int, query_id: str = "id", query_vec: str = "vec", id_col: str = "id", vec_col: str = "vec", exclude_self: bool = False, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosine_distance) -> DataFrame:
    """``(query_id, rank, id, dist)``: the exact k nearest elements of each query.

    ``exclude_self``: an element of the query's id is left out. ``distance``: a distance of one's
    own, a function of a matrix of queries and one of elements.
    """
    rows = elements.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    wanted = asked(queries, query_id, query_vec)
    kind = "query_id long, id long, dist double"
    some = wanted.limit(QUERY_BLOCK + 1).toArrow()
    if some.num_rows > QUERY_BLOCK:
        n, block = wanted.count(), max(1, QUERY_BYTES // (8 * len(some.column("vec")[0]) + 16 * k))
        if n > block:
            return merged_top(_in_blocks(wanted, rows, math.ceil(n / block)).mapInArrow(_blockwise(k, exclude_self, distance), kind), k)
        some = wanted.toArrow()
    if some.num_rows:
        sent = queries.sparkSession.sparkContext.broadcast(_held(some))
        # each task gives k rows a query, so there are no more tasks than run at once
        parts = spread(rows).coalesce(default_parallelism(queries.sparkSession)).mapInArrow(_partial(lambda: sent.value, k, exclude_self, distance), kind)
    else:
        parts = elements.sparkSession.createDataFrame([], kind)
    return merged_top(parts, k)


def _in_blocks(queries: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """``(unit, element, id, vec)``: each block of queries with each part of the elements in a partition of its own, queries first.

    Elements are sent once for each block of queries, queries once for each part of the elements; there are as many
    parts as keep the cluster busy.
    """
    parts = max(1, math.ceil(2 * default_parallelism(queries.sparkSession) / blocks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n")
    asked_of = queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), numbers(parts), "id", "vec").select("block", F.col("n").alias("part"), F.lit(False).alias("element"), "id", "vec")
    held_by = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), numbers(blocks), "id", "vec").select(F.col("n").cast("long").alias("block"), "part", F.lit(True).alias("element"), "id", "vec")
    both = asked_of.unionByName(held_by).select((F.col("block") * parts + F.col("part")).cast("int").alias("unit"), "element", "id", "vec")
    return both.repartitionById(blocks * parts, F.col("unit")).sortWithinPartitions("element", "id")


def _blockwise(k: int, exclude_self: bool, distance: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """A function for ``mapInArrow`` over the partitions of ``_in_blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def parted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                element = b.column("element")
                first = pc.sum(pc.invert(element)).as_py() or 0
                if first:
                    held.append(b.slice(0, first).select(["id", "vec"]))
                if first < b.num_rows:
                    yield b.slice(first).select(["id", "vec"])

        rest = parted()
        start = next(rest, None)
        if start is None or not held:
            return
        ids = np.concatenate([h.column("id").to_numpy() for h in held])
        dim = len(held[0].column("vec")[0])
        q = np.concatenate([matrix(h.column("vec"), dim) for h in held])
        yield from _partial(lambda: (ids, q), k, exclude_self, distance)(itertools.chain([start], rest))

    return run


def knn_by(queries: DataFrame, elements: DataFrame, k: int, dist: Callable[[Column, Column], Column], key: str) -> DataFrame:
    """Nearest elements by a distance of one's own, a function of two columns, among elements that share the column ``key`` with the query.

    Queries: ``(query_id, payload, key)``; elements: ``(id, payload, key)``.
    """
    q = queries.select("query_id", F.col("payload").alias("q"), F.col(key).alias("qk"))
    pairs = elements.join(q, F.col(key) == F.col("qk")).select("query_id", "id", dist(F.col("q"), F.col("payload")).alias("dist"))
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def edges_of(result: DataFrame) -> DataFrame:
    """``(node, nbr, dist)`` from nearest neighbours."""
    return result.select(F.col("query_id").alias("node"), F.col("id").alias("nbr"), "dist")


def symmetrized(edges: DataFrame) -> DataFrame:
    """Edges with the reverse of each, once each; no loops."""
    both = edges.select("node", "nbr", "dist").unionByName(edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "dist"))
    return both.where("node <> nbr").groupBy("node", "nbr").agg(F.min("dist").alias("dist"))


def capped(edges: DataFrame, degree: int) -> DataFrame:
    """``(node, neighbors)``: each node's nearest neighbours up to the degree, ordered by id as they are stored."""
    best = edges.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "nbr"))), 1, degree).alias("top"))
    return best.select("node", F.array_sort(F.transform("top", lambda e: e["nbr"])).alias("neighbors"))


def select_neighbors(candidates: Column, limit: int) -> Column:
    """The candidates that are kept, of an array of structs ``(d, id, v)`` sorted by ``(d, id)``.

    All, if there are no more than ``limit``; else, in order of distance, each that is at least
    as near to the element as to every one kept before, up to ``limit``.
    """
    near = lambda acc, x: F.forall(acc, lambda n: x["d"] <= V.angular_any(n["v"], x["v"]))
    fold = F.aggregate(candidates, F.filter(candidates, lambda x: F.lit(False)), lambda acc, x: F.when((F.size(acc) < limit) & near(acc, x), F.array_append(acc, x)).otherwise(acc))
    return F.when(F.size(candidates) <= limit, candidates).otherwise(fold)
