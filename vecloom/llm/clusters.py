"""Clusters of similar vectors by distributed k-means, and the groups that they hold.

Seeding is k-means||: in each of a few passes every vector is drawn with a probability in
proportion to its squared distance from the centres so far (about ``oversample`` x k draws a
pass); the draws, weighted by the vectors nearest to each, are reduced to k centres by
weighted k-means++ on the driver, where they number a few k whatever the table's size. Lloyd
passes follow, each partition sending only sums. ``k`` follows the size of the table (its
square root). Draws come from hashes of the ids: a rerun, or a task that runs twice, draws the
same.

Clusters (``clustered``): every vector is assigned to its nearest centroid; a cluster is described by
its size and the members nearest its centroid. Records of terms are vectorised first, by hashed
weighted features (``vectors.hashed_features``).

Groups: in the last pass each centre gets its most typical member, the vector nearest to it.
A group is a set of vectors that all lie within ``limit`` of each other with every other vector
farther away. Every vector is assigned to the nearest typical member; it belongs to that one's group
if it lies within ``limit`` of it. Typical members within ``limit`` of each other are of one
group, and a vector that is near some but not all of them, or near those of another group too,
shows that it is no such set: it is dropped. Vectors near no typical member are then
compared with each other, all of a cell, within the cells of their two nearest centres, and where
``RESIDUAL`` or more lie together, one becomes a further typical member: a group that the
seeding missed. All of them take part in the assignment. A group's members are ranked by their
distance from the group's centroid, the mean of all its members.

Nulls, zero vectors and vectors of another length (see ``vectors``) belong to no cluster; a
table without vectors has none. Rows that share an id count once as members; in centroids, a row
delivered twice weighs twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import vectors as V
from vecloom.session import checkpointed

#: Vectors near no typical member that lie together before one is taken for a member of a missed group.
RESIDUAL = 4
#: Comparisons of a cell's vectors that are held at once.
CELL_BLOCK = 2048 * 2048


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors: the nearest centre's place and the distance 1 - cosine."""
    best, where = np.full(len(x), -np.inf, "f4"), np.zeros(len(x), "i4")
    for at in range(0, len(centres), 1024):
        s = x @ centres[at : at + 1024].T
        w = s.argmax(1)
        v = s[np.arange(len(x)), w]
        better = v > best
        best[better], where[better] = v[better], w[better] + at
    return where, np.maximum(0, 1 - best)


def _rows(df: DataFrame) -> list:
    return df.collect()


def _unpack(blobs: list, dim: int, kind: str = "f4") -> np.ndarray:
    return np.frombuffer(b"".join(bytes(b) for b in blobs), kind).reshape(-1, dim) if blobs else np.empty((0, dim), kind)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype("f4")


def _draw(vecs: DataFrame, dim: int, centres: np.ndarray, wanted: float, cost: float, salt: int) -> tuple[np.ndarray, float]:
    """One pass: vectors drawn in proportion to their cost, at the total cost so far, and the total cost now."""

    def make():
        total = [0.0]

        def work(ids: np.ndarray, x: np.ndarray):
            _, d = _nearest(x, centres)
            total[0] += float(d.sum())
            drawn = V.hashed_unit(ids, salt) < np.minimum(1.0, wanted * d / cost) if cost > 0 else np.zeros(len(ids), bool)
            return pa.record_batch([V.packed(x[drawn]), pa.nulls(int(drawn.sum()), pa.float64())], names=["vec", "cost"])

        return V.per_rows(work, dim, lambda: pa.record_batch([pa.nulls(1, pa.binary()), pa.array([total[0]])], names=["vec", "cost"]))

    def run(batches):
        yield from make()(batches)

    out = _rows(vecs.mapInArrow(run, "vec binary, cost double"))
    return np.unique(_unpack([r["vec"] for r in out if r["vec"] is not None], dim), axis=0), sum(r["cost"] or 0.0 for r in out)


def _sums(vecs: DataFrame, dim: int, centres: np.ndarray, of: np.ndarray | None = None, limit: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One pass: the vectors' number and sum for each centre, added up in four tasks before they reach the driver.

    ``of``: the group of each centre; then numbers and sums are those of groups. ``limit``: vectors farther from their centre are left out.
    """
    k = len(centres) if of is None else int(of.max()) + 1

    def partial(batches):
        count, total = np.zeros(k, "i8"), np.zeros((k, dim), "f8")

        def work(ids: np.ndarray, x: np.ndarray):
            where, d = _nearest(x, centres)
            if limit is not None:
                x, where = x[d <= limit], where[d <= limit]
            if not len(x):
                return
            where = where if of is None else of[where]
            order = np.argsort(where, kind="stable")
            heads = np.flatnonzero(np.diff(where[order], prepend=-1))
            total[where[order][heads]] += np.add.reduceat(x[order], heads, axis=0)
            count[:] += np.bincount(where, minlength=k)

        from pyspark import TaskContext

        yield from V.per_rows(work, dim)(batches)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % 4], pa.int32()), pa.array([count.tobytes()]), pa.array([total.tobytes()])], names=["slot", "n", "total"])

    def summed(batches):
        count, total = np.zeros(k, "i8"), np.zeros(k * dim, "f8")
        for b in batches:
            for n, t in zip(b.column("n").to_pylist(), b.column("total").to_pylist()):
                count += np.frombuffer(n, "i8")
                total += np.frombuffer(t, "f8")
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([count.tobytes()]), pa.array([total.tobytes()])], names=["slot", "n", "total"])

    kind = "slot int, n binary, total binary"
    parts = _rows(vecs.mapInArrow(partial, kind).repartition(4, "slot").mapInArrow(summed, kind))
    return sum(np.frombuffer(r["n"], "i8") for r in parts), sum(np.frombuffer(r["total"], "f8") for r in parts).reshape(k, dim)


def _reduced(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Weighted k-means++ and a few Lloyd rounds over the draws."""
    if len(points) <= k:
        return points
    rng = np.random.default_rng(1)
    chosen = [int(np.argmax(weights))]
    d = np.maximum(0, 1 - points @ points[chosen[0]])
    for _ in range(k - 1):
        p = weights * d
        if p.sum() <= 0:
            break
        chosen.append(int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, len(points) - 1)))
        d = np.minimum(d, np.maximum(0, 1 - points @ points[chosen[-1]]))
    centres = points[chosen]
    for _ in range(rounds):
        where, _ = _nearest(points, centres)
        total = np.zeros(centres.shape, "f8")
        np.add.at(total, where, points * weights[:, None])
        moved = np.linalg.norm(total, axis=1) > 0
        centres = np.where(moved[:, None], _unit(total), centres).astype("f4")
    return centres


def kmeans_centres(vecs: DataFrame, dim: int, k: int, oversample: float = 2.0, draws: int = 3, lloyd: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The unit centres and the number of vectors of each; centres without vectors are dropped."""
    start = vecs.limit(1).mapInArrow(V.per_rows(lambda ids, x: pa.record_batch([V.packed(x[:1])], names=["vec"]), dim), "vec binary")
    centres = _unpack([r["vec"] for r in start.collect()], dim)
    if not len(centres):
        every = vecs.mapInArrow(V.per_rows(lambda ids, x: pa.record_batch([V.packed(x[:1])], names=["vec"]), dim), "vec binary").first()
        if every is None:
            return np.empty((0, dim), "f4"), np.empty(0, "i8")
        centres = _unpack([every["vec"]], dim)
    _, cost = _draw(vecs, dim, centres, 0, 0.0, 0)
    for r in range(draws):
        more, cost = _draw(vecs, dim, centres, oversample * k, cost, r + 1)
        centres = np.vstack([centres, more]) if len(more) else centres
    counts, _ = _sums(vecs, dim, centres)
    centres = _reduced(centres, counts.astype("f8"), k)
    for _ in range(lloyd):
        counts, total = _sums(vecs, dim, centres)
        held = counts > 0
        centres, counts = _unit(total[held]), counts[held]
    return centres, counts


def _typical(vecs: DataFrame, dim: int, centres: np.ndarray) -> np.ndarray:
    """The member nearest to each centre; one row per centre and partition is sent, one per centre arrives."""

    def run(batches):
        best, rows = np.full(len(centres), np.inf), np.zeros(centres.shape, "f4")

        def work(ids: np.ndarray, x: np.ndarray):
            where, d = _nearest(x, centres)
            order = np.lexsort((ids, d, where))
            first = order[np.flatnonzero(np.diff(where[order], prepend=-1))]
            better = d[first] < best[where[first]]
            best[where[first][better]], rows[where[first][better]] = d[first][better], x[first][better]

        yield from V.per_rows(work, dim)(batches)
        seen = np.flatnonzero(np.isfinite(best))
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(best[seen]), V.packed(rows[seen])], names=["centre", "d", "vec"])

    nearest = vecs.mapInArrow(run, "centre int, d double, vec binary").groupBy("centre").agg(F.min(F.struct("d", "vec")).alias("m"))
    return _unpack([r["vec"] for r in nearest.select("centre", "m.vec").orderBy("centre").collect()], dim)


@dataclass
class _Leads:
    """Typical members by group: those within the limit of each other are of one group, broken unless all of it are."""

    points: np.ndarray
    group: np.ndarray
    centres: np.ndarray
    broken: np.ndarray

    @staticmethod
    def of(points: np.ndarray, limit: float) -> _Leads:
        n = len(points)
        a, b = [np.empty(0, "i8")], [np.empty(0, "i8")]
        for at in range(0, n, 1024):
            i, j = np.nonzero(1 - points[at : at + 1024] @ points.T <= limit)
            a.append(i + at)
            b.append(j)
        a, b = np.concatenate([*a, np.arange(n)]), np.concatenate([*b, np.arange(n)])
        group = np.arange(n)
        while True:  # the smallest place of all that hang together
            least = group.copy()
            np.minimum.at(least, a, group[b])
            least = np.minimum(least, least[least])
            if (least == group).all():
                break
            group = least
        roots, group = np.unique(group, return_inverse=True)
        size, near = np.bincount(group), np.bincount(group[a[a != b]], minlength=len(roots))
        total = np.zeros((len(roots), points.shape[1]))
        np.add.at(total, group, points)
        return _Leads(points, group, _unit(total), near != size * (size - 1))


def _against_leads(vecs: DataFrame, dim: int, leads: _Leads, limit: float, centres: np.ndarray | None = None) -> DataFrame:
    """``(id, grp, whole, d)``: each vector within the limit of the typical member it is assigned to, that one's group, whether it is near all of the group's and of no other, its distance from the group's centroid."""
    sizes = np.bincount(leads.group, minlength=len(leads.centres))
    order = np.argsort(leads.group, kind="stable")
    points, group = leads.points[order], leads.group[order]
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    centres = leads.centres if centres is None else centres

    def work(ids: np.ndarray, x: np.ndarray):
        s = x @ points.T
        nearest = s.argmax(1)
        hit = s[np.arange(len(x)), nearest] >= 1 - limit
        ids, x, near, own = ids[hit], x[hit], s[hit] >= 1 - limit, group[nearest[hit]]
        if not len(ids):
            return None
        per_group = np.add.reduceat(near, heads, axis=1, dtype="i4")
        whole = (per_group[np.arange(len(ids)), own] == sizes[own]) & ((per_group > 0).sum(1) == 1)
        middle = 1 - np.einsum("ij,ij->i", x, centres[own])
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array(whole), pa.array(np.maximum(0, middle), pa.float32())], names=["id", "grp", "whole", "d"])

    return vecs.mapInArrow(V.per_rows(work, dim), "id long, grp int, whole boolean, d float")


def _missed(vecs: DataFrame, dim: int, centres: np.ndarray, leads: np.ndarray, limit: float) -> np.ndarray:
    """Members of groups without a typical member: vectors near none, compared within the cells of their two nearest centres."""
    few = min(2, len(centres))

    def uncovered(ids: np.ndarray, x: np.ndarray):
        out = ~((x @ leads.T) >= 1 - limit).any(1) if len(leads) else np.ones(len(x), bool)
        ids, x = ids[out], x[out]
        if not len(ids):
            return None
        s = x @ centres.T
        cells = np.argpartition(-s, few - 1, axis=1)[:, :few] if s.shape[1] > few else np.tile(np.arange(s.shape[1]), (len(x), 1))
        m = cells.shape[1]
        return pa.record_batch([pa.array(cells.ravel(), pa.int32()), pa.array(np.repeat(ids, m), pa.int64()), V.packed(np.repeat(x, m, axis=0))], names=["cell", "id", "vec"])

    def together(batches):
        def seeds(x: np.ndarray) -> list[np.ndarray]:
            def among(y: np.ndarray) -> np.ndarray:
                """How many of ``y`` each vector is near, in blocks."""
                step = max(1, CELL_BLOCK // max(1, len(y)))
                return np.concatenate([((x[at : at + step] @ y.T) >= 1 - limit).sum(1) for at in range(0, len(x), step)])

            count, out = among(x), []
            while count.max() >= RESIDUAL:
                i = int(count.argmax())
                out.append(x[i])
                gone = (x @ x[i]) >= 1 - limit
                gone[i] = True
                count = count - among(x[gone])
                count[gone] = 0
            return out

        cell, ids, rows = None, [], []
        for b in batches:
            cells = b.column("cell").to_numpy()
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), "f4").reshape(-1, dim)
            own = b.column("id").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(cells, prepend=cells[0] - 1)), len(cells))
            for a, z in zip(cuts[:-1], cuts[1:]):
                if cells[a] != cell:
                    if found := seeds(_one_each(ids, rows)) if rows else []:
                        yield pa.record_batch([V.packed(np.array(found))], names=["vec"])
                    cell, ids, rows = cells[a], [], []
                ids.extend(own[a:z].tolist())
                rows.extend(x[a:z])
        if rows and (found := seeds(_one_each(ids, rows))):
            yield pa.record_batch([V.packed(np.array(found))], names=["vec"])

    cells = vecs.mapInArrow(V.per_rows(uncovered, dim), "cell int, id long, vec binary")
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(together, "vec binary")
    return np.unique(_unpack([r["vec"] for r in found.collect()], dim), axis=0)  # one per missed group and cell; those of one group are recognised as such


def _one_each(ids: list[int], rows: list[np.ndarray]) -> np.ndarray:
    """The vectors of distinct ids."""
    _, first = np.unique(np.asarray(ids), return_index=True)
    return np.asarray(rows)[first]


def similarity_groups(df: DataFrame, id_col: str, vec_col: str, limit: float = 0.15, min_size: int = 8, k: int | None = None, ranked: bool = True) -> DataFrame:
    """``(lead_id, id, d)``: the members of every group of at least ``min_size`` ids, with the group's smallest id and each member's distance from its centroid (without ``ranked``: from the middle of its typical members, which saves a pass)."""
    empty = "lead_id long, id long, d float"
    vecs = V.selected(df, id_col, vec_col)
    dim, n = V.dimension_and_count(vecs)
    if not n:
        return df.sparkSession.createDataFrame([], empty)
    centres, counts = kmeans_centres(vecs, dim, k or max(8, math.ceil(math.sqrt(n))))
    if not len(centres):
        return df.sparkSession.createDataFrame([], empty)
    typical = _typical(vecs, dim, centres)
    more = _missed(vecs, dim, centres, typical, limit)
    leads = _Leads.of(np.vstack([typical, more]) if len(more) else typical, limit)
    middles = None
    if ranked:
        _, total = _sums(vecs, dim, leads.points, leads.group, limit)
        middles = _unit(total)
    near = checkpointed(_against_leads(vecs, dim, leads, limit, middles).groupBy("id").agg(F.min("grp").alias("grp"), F.min("whole").alias("whole"), F.min("d").alias("d")))
    groups = near.groupBy("grp").agg(F.min("id").alias("lead_id"), F.count("*").alias("size"), F.min("whole").alias("sound"))
    broken = [int(g) for g in np.flatnonzero(leads.broken)]
    sound = groups.where(F.col("sound") & (F.col("size") >= min_size) & ~F.col("grp").isin(broken)).select(F.col("grp").alias("of"), "lead_id")
    return near.join(sound, F.col("grp") == F.col("of")).select("lead_id", "id", "d")


def clustered(df: DataFrame, id_col: str, vec_col: str, k: int | None = None) -> DataFrame:
    """``(cluster, id, d)``: every vector's cluster of k-means and its distance from the cluster's centroid, one row per id."""
    vecs = V.selected(df, id_col, vec_col)
    dim, n = V.dimension_and_count(vecs)
    kind = "cluster int, id long, d float"
    centres, _ = kmeans_centres(vecs, dim, k or max(8, math.ceil(math.sqrt(n)))) if n else (np.empty((0, 1), "f4"), None)
    if not len(centres):
        return df.sparkSession.createDataFrame([], kind)
    _, total = _sums(vecs, dim, centres)
    middles = _unit(total)

    def work(ids: np.ndarray, x: np.ndarray):
        where, _ = _nearest(x, centres)
        d = np.maximum(0, 1 - np.einsum("ij,ij->i", x, middles[where]))
        return pa.record_batch([pa.array(where, pa.int32()), pa.array(ids, pa.int64()), pa.array(d, pa.float32())], names=["cluster", "id", "d"])

    assigned = vecs.mapInArrow(V.per_rows(work, dim), kind)
    return assigned.groupBy("id").agg(F.min(F.struct("cluster", "d")).alias("c")).select("c.cluster", "id", "c.d")


def described_groups(groups: DataFrame, typical: int = 5) -> DataFrame:
    """``(lead_id, size, typical)``: each group's size and the ids of its members nearest the centroid.

    The nearest are found in two steps (by a hash of the id, then overall), so that no task
    sorts a large group.
    """
    from pyspark.sql import Window

    part = groups.withColumn("salt", F.pmod(F.hash("id"), F.lit(64)))
    by = Window.partitionBy("lead_id", "salt").orderBy("d", "id")
    some = part.withColumn("r", F.row_number().over(by)).where(F.col("r") <= typical)
    best = some.groupBy("lead_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, typical).alias("top"))
    sizes = groups.groupBy(F.col("lead_id").alias("of")).agg(F.count("*").alias("size"))
    return best.join(sizes, F.col("lead_id") == F.col("of")).select("lead_id", "size", F.transform("top", lambda t: t["id"]).alias("typical"))
