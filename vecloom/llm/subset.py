"""A varied subset of vectors of a given size, by minimum-cost flow quotas.

Every record gets two categories: its region and its side (the signs of its offset from the
region's middle along a few fixed random directions). Regions follow the variety of the data,
not the subset's size: the typical members of k-means clusters (the square root of the records),
and members of the groups that these miss, as ``clusters`` finds them. Records within ``GROUP``
of a typical member are that group's region, all others nearest to it are a region of their own,
so that loose records do not stand for a group. Records are counted by combination of categories: at most regions x
sides counts, whatever the number of records. The quotas of the combinations are the flow of
least cost from a source over regions, combinations (capacity: their records) and sides to a
sink; every region and every side has an equal share of the subset as its target, and what is
used beyond a target costs ever more. Every region that is not empty gets one record before any
gets more; if the subset is smaller than that, the regions with most records. Combinations are then filled by a deterministic rank, a
hash of the id. Crowded regions are thereby held to their share, and what thin regions cannot
fill is spread over the others evenly.

The rank within a combination is found in two steps (by salt, then overall), each bounded by
the quota, so that no task sorts a crowded combination.

Nulls, zero vectors and vectors of another length take no part. Rows that share an id count
once. A subset as large as the table, or larger, is the table; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm import vectors as V
from vecloom.llm.clusters import _Leads, _missed, _nearest, _typical, kmeans_centres
from vecloom.session import checkpointed

SALTS = 32
#: Records so near a typical member are of its group.
GROUP = 0.15


def flow_quotas(counts: np.ndarray, size: int, steps: int = 4096) -> np.ndarray:
    """Quotas (regions x sides) that add up to ``size`` (or all records): flow of least cost under convex penalties for use beyond the equal share.

    Each region that is not empty gets one at least, those with most records first.
    Successive shortest paths. A subset of up to ``steps`` records is solved record by record,
    a larger one in as many portions.
    """
    counts = counts.astype("i8")
    size = int(min(size, counts.sum()))
    quota = np.zeros_like(counts)
    regions, sides = counts.shape
    use_r, use_s = np.zeros(regions), np.zeros(sides)
    held = counts.sum(1)
    first = 1e9 * (1 + held / max(1, held.max(initial=0)))  # above any penalty
    share_r, share_s = max(size / max(1, np.count_nonzero(held)), 1e-9), max(size / sides, 1e-9)

    def marginal(use: np.ndarray, share: float, amount: float) -> np.ndarray:
        # overuse costs its square; a small cost of use itself keeps targets even below the share
        over = lambda u: np.maximum(0, u - share) ** 2 / share + 1e-3 * u**2 / share
        return (over(use + amount) - over(use)) / amount

    placed = 0
    while placed < size:
        waiting = (use_r < 1) & (held > 0)
        amount = 1 if waiting.any() else min(max(1, size // steps), size - placed)
        start, end = marginal(use_r, share_r, amount), marginal(use_s, share_s, amount)
        room, back = counts - quota, quota
        start = start - np.where(waiting, first, 0)
        dist_r, from_r = start.copy(), np.full(regions, -1)
        dist_s, from_s = np.full(sides, np.inf), np.full(sides, -1)
        while True:
            reach = np.where(room > 0, dist_r[:, None], np.inf)
            best, which = reach.min(0), reach.argmin(0)
            better = best < dist_s - 1e-12
            dist_s[better], from_s[better] = best[better], which[better]
            reach = np.where(back > 0, dist_s[None, :], np.inf)
            best, which = reach.min(1), reach.argmin(1)
            again = best < dist_r - 1e-12
            if not better.any() and not again.any():
                break
            dist_r[again], from_r[again] = best[again], which[again]
        s = int((dist_s + end).argmin())
        last, path = s, []
        while True:
            r = int(from_s[s])
            path.append((r, s, 1))
            amount = min(amount, int(room[r, s]))
            if from_r[r] < 0:
                break
            s = int(from_r[r])
            path.append((r, s, -1))
            amount = min(amount, int(back[r, s]))
        for r, s, sign in path:
            quota[r, s] += sign * amount
        use_r[path[-1][0]] += amount
        use_s[last] += amount
        placed += amount
    return quota


def _categories(vecs: DataFrame, dim: int, leads: _Leads, bits: int) -> DataFrame:
    points, group, centres = leads.points, leads.group, leads.centres
    directions = np.random.default_rng(7).standard_normal((dim, bits)).astype("f4")
    offsets = centres @ directions
    powers = 1 << np.arange(bits)

    def work(ids: np.ndarray, x: np.ndarray):
        lead, d = _nearest(x, points)
        region = group[lead]
        side = ((x @ directions > offsets[region]) * powers).sum(1)
        region = np.where(d <= GROUP, region, region + len(centres))
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(region, pa.int32()), pa.array(side, pa.int32())], names=["id", "region", "side"])

    return vecs.mapInArrow(V.per_rows(work, dim), "id long, region int, side int").groupBy("id").agg(F.min(F.struct("region", "side")).alias("c")).select("id", "c.region", "c.side")


def varied_subset(df: DataFrame, id_col: str, vec_col: str, size: int | None = None, share: float = 0.01, regions: int | None = None, bits: int = 3) -> DataFrame:
    """``(id, region, side)`` of ``size`` ids (default: ``share`` of the table's, 64 at least) that cover the variety of the vectors."""
    spark = df.sparkSession
    empty = "id long, region int, side int"
    vecs = V.selected(df, id_col, vec_col)
    dim, n = V.dimension_and_count(vecs)
    size = max(64, int(n * share)) if size is None else size
    if not n or size <= 0:
        return spark.createDataFrame([], empty)
    centres, _ = kmeans_centres(vecs, dim, regions or max(8, math.ceil(math.sqrt(n))), lloyd=1)
    if not len(centres):
        return spark.createDataFrame([], empty)
    typical = _typical(vecs, dim, centres)
    leads = _Leads.of(np.vstack([typical, _missed(vecs, dim, centres, typical, GROUP)]), GROUP)
    known = checkpointed(_categories(vecs, dim, leads, bits))
    counts = np.zeros((2 * len(leads.centres), 1 << bits), "i8")
    for r in known.groupBy("region", "side").agg(F.count("*").alias("n")).collect():  # regions x sides rows at most
        counts[r["region"], r["side"]] = r["n"]
    quota = flow_quotas(counts, size)
    wanted = [(int(r), int(s), int(quota[r, s])) for r, s in zip(*np.nonzero(quota))]
    quotas = spark.createDataFrame(wanted, "of_region int, of_side int, quota int")
    offered = known.join(F.broadcast(quotas), (F.col("region") == F.col("of_region")) & (F.col("side") == F.col("of_side"))).select("id", "region", "side", "quota", F.xxhash64("id").alias("h"))
    first = Window.partitionBy("region", "side", "salt").orderBy("h", "id")
    some = offered.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).withColumn("r", F.row_number().over(first)).where(F.col("r") <= F.col("quota")).drop("r", "salt")
    last = Window.partitionBy("region", "side").orderBy("h", "id")
    return some.withColumn("r", F.row_number().over(last)).where(F.col("r") <= F.col("quota")).select("id", "region", "side")
