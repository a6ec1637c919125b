"""The most similar vectors of every vector, from robust-pruned graphs over shards.

Routing: centres (about the square root of the rows) are fitted on a bounded sample of
``SAMPLE`` rows; neighbouring centres are gathered into shards of about ``SHARD_ROWS`` rows by
repeated halving. Every row is a member of the shard of its nearest centre. It visits every other
shard with a centre that is at most ``VISIT_ANGLE`` farther than its own nearest; or, where only
neighbours within a given distance are asked for, every shard that can hold one: the arc between
two such vectors in different shards crosses the plane between their centres, so that neither is farther from it than they are apart.
Then one of the two visits is enough (to the later shard): its answer counts for both rows, and is
as long as there are vectors within the distance. How many shards
are visited is not limited: a row far from all centres, whose neighbours may be anywhere, visits many.

Each shard builds the graph over its members, and beam searches in it answer members and
visitors (see ``graph``): what these searches find is the result, and the results of a row's
shards are merged. A shard that the halving leaves too large (one crowded centre) is divided by a
hash into several, each of which its members and visitors visit; a shard with very many visitors
is there several times, and each copy answers a part of them.

``complete``: an exact search follows. Each row is then sent to every
shard that can still hold a vector as near as the row's ``k``-th: by the triangle
inequality, from the angles of the row and of the shard's closest member to the row's nearest
centres (``_beyond``). For this pass shards are gathered into groups of about
``GROUP_ROWS`` rows, so that a row with no near neighbours is sent to few tasks. Its work grows
with the square of the rows without near neighbours.

Exact copies are collapsed before anything is sent, batch by batch, and again in the shard, so
that a vector that is delivered a million times is one node; the copies get their neighbours by
a join on their representative, of which a large group has many.

``recall`` holds a sample of the results against brute force, in blocks.

Nulls, zero vectors and vectors of another length take no part and are nobody's neighbours.
Rows that share an id count once per different vector. Ties in distance are ordered by id.
A table with fewer than k + 1 vectors gives shorter lists; an empty one none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import graph
from vecloom.llm import vectors as V
from vecloom.llm.clusters import _nearest, _unit
from vecloom.session import checkpointed, default_parallelism

SAMPLE = 32_768
SHARD_ROWS = 100_000
#: Rows that one task searches for: a shard with more visitors is answered by several.
SEARCH_ROWS = 160_000
#: A shard is visited if its nearest centre is at most so much farther (in radians) than the row's own.
VISIT_ANGLE = 0.35
#: Members that one task of the second pass holds, where there are more shards than tasks.
GROUP_ROWS = 320_000
#: What angles from single precision may be off.
ANGLE_ERROR = 2e-3
#: A row's nearest centres by which a shard is ruled out.
PIVOTS = 4


@dataclass
class Routes:
    """Centres, the shard of each, and the number of shards."""

    centres: np.ndarray
    shard: np.ndarray
    shards: int

    def __post_init__(self) -> None:
        self._order = np.argsort(self.shard, kind="stable")
        self._heads = np.searchsorted(self.shard[self._order], np.arange(self.shards))
        self._apart = np.sqrt(np.maximum(0, 2 - 2 * self.centres @ self.centres.T)).astype("f4")

    def angles(self, x: np.ndarray) -> np.ndarray:
        """Rows x shards: the angle to the shard's nearest centre."""
        return np.arccos(np.clip(np.maximum.reduceat((x @ self.centres.T)[:, self._order], self._heads, axis=1), -1, 1))

    def visited(self, x: np.ndarray, visits: int | None, within: float | None, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The home shard of each row, and rows x shards: those that it visits besides (at most ``visits``, if that is given; ``once``: with ``within``, the later ones only)."""
        s = x @ self.centres.T
        every = np.arange(len(x))
        own = s.argmax(1)
        home = self.shard[own]
        if within is not None:
            # by the distance from the plane between the own centre and another (twice the same centre: no plane)
            gap, apart = s[every, own][:, None] - s, self._apart[own]
            plane = np.where(apart > 1e-6, gap / np.maximum(apart, 1e-6), 0)
            near = np.minimum.reduceat(plane[:, self._order], self._heads, axis=1) <= math.sin(min(math.pi / 2, math.acos(max(-1.0, 1 - within)) + ANGLE_ERROR))
            if once:
                near &= np.arange(self.shards) > home[:, None]
        else:
            angles = np.arccos(np.clip(np.maximum.reduceat(s[:, self._order], self._heads, axis=1), -1, 1))
            near = angles <= angles.min(1, keepdims=True) + VISIT_ANGLE
            if visits is not None:
                rank = np.argsort(np.argsort(np.where(near, angles, np.inf), axis=1), axis=1)
                near &= rank < visits
        near[every, home] = False
        return home, near


@dataclass
class Deal:
    """How shards are dealt to tasks: into how many each is divided, how many copies of it there are, and the first task of each."""

    divided: np.ndarray
    copies: np.ndarray
    first: np.ndarray
    tasks: int

    @staticmethod
    def of(members: np.ndarray, visitors: np.ndarray, shard_rows: int) -> Deal:
        """From the expected rows of each shard: they decide how work is spread, never what is found."""
        divided = np.maximum(1, np.ceil(members / (2 * shard_rows))).astype("i8")
        copies = np.maximum(1, np.ceil((visitors + members * (divided > 1)) / max(SEARCH_ROWS, 4 * shard_rows))).astype("i8")
        first = np.concatenate([[0], np.cumsum(divided * copies)])
        return Deal(divided, copies, first[:-1], int(first[-1]))


def fitted_routes(vecs: DataFrame, dim: int, n: int, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> Routes:
    """Centres and shards from a sample of at most about ``sample`` rows, drawn by a hash of the id."""
    return _fitted(_sampled(vecs, dim, n, sample), dim, n, shard_rows)


def _sampled(vecs: DataFrame, dim: int, n: int, sample: int) -> np.ndarray:
    part = min(1.0, sample / n)

    def draw(ids: np.ndarray, x: np.ndarray):
        return pa.record_batch([V.packed(x[V.hashed_unit(ids, 11) < part])], names=["vec"])

    blobs = vecs.mapInArrow(V.per_rows(draw, dim), "vec binary").collect()
    return np.unique(np.frombuffer(b"".join(bytes(r["vec"]) for r in blobs), "f4").reshape(-1, dim), axis=0)


def _fitted(x: np.ndarray, dim: int, n: int, shard_rows: int) -> Routes:
    if not len(x):
        return Routes(np.eye(1, dim, dtype="f4"), np.zeros(1, "i8"), 1)
    k = min(len(x), max(1, math.ceil(math.sqrt(n))), 4096)
    rng = np.random.default_rng(3)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(4):
        where, _d = _nearest(x, centres)
        total, count = np.zeros(centres.shape), np.bincount(where, minlength=k)
        np.add.at(total, where, x)
        centres = np.where(count[:, None] > 0, _unit(total), centres).astype("f4")
    where, _d = _nearest(x, centres)
    weight = np.bincount(where, minlength=k) * (n / len(x))
    shard, todo, at = np.zeros(k, "i8"), [np.arange(k)], 0
    while todo:
        own = todo.pop()
        if len(own) == 1 or weight[own].sum() <= shard_rows:
            shard[own], at = at, at + 1
            continue
        # halve along the line between two far centres, at half of the weight
        a = centres[own[0]]
        b = centres[own[int((centres[own] @ a).argmin())]]
        a = centres[own[int((centres[own] @ b).argmin())]]
        order = own[np.argsort(centres[own] @ (a - b), kind="stable")]
        cut = int(np.clip(np.searchsorted(np.cumsum(weight[order]), weight[order].sum() / 2), 1, len(order) - 1))
        todo += [order[:cut], order[cut:]]
    return Routes(centres, shard, at)


_ROUTED = "unit int, kind int, shard int, home boolean, id long, rep long, vec binary, copies array<long>"
#: Kinds of rows: members that are searched for, members of a further copy of the shard, rows that are only searched for, links.
SEARCHED, HELD, GUEST, LINK = range(4)


def _routed(vecs: DataFrame, dim: int, routes: Routes, k: int, visits: int | None, within: float | None, deal: Deal | None = None) -> DataFrame:
    """Rows for the shards; exact copies within a batch as links (shard -1) to the one that is sent.

    The rows of a partition are put in order first, so that a task that runs again sends the same.
    """

    def work(ids: np.ndarray, x: np.ndarray):
        keys = np.ascontiguousarray(x).view(f"V{4 * dim}").ravel()
        order = np.argsort(ids, kind="stable")
        _, first, inverse = np.unique(keys[order], return_index=True, return_inverse=True)
        rep_at = order[first]  # the smallest id of each vector
        rep_of = np.empty(len(ids), "i8")
        rep_of[order] = ids[rep_at][inverse]
        links = np.flatnonzero(ids != rep_of)
        extra: dict[int, list[int]] = {}
        for i in links.tolist():
            extra.setdefault(int(rep_of[i]), []).append(int(ids[i]))
        xs, own = x[rep_at], ids[rep_at]
        home, near = routes.visited(xs, visits, within, deal is not None)
        r, s = np.nonzero(near)
        m, e = len(xs), len(links)
        if deal is None:
            at, shard = np.concatenate([np.arange(m), r]), np.concatenate([home, s])
            kind, unit, link_unit = np.repeat([SEARCHED, GUEST], [m, len(r)]), shard, np.zeros(e, "i8")
        else:
            at, shard, kind, unit = _dealt(deal, own, home, r, s)
            link_unit = ids[links] % deal.tasks
        held = kind <= (HELD if within is None else GUEST)  # copies of guests: for the answers that count for members
        copies = [sorted(set(extra[i]))[:k] if i in extra else None for i in own.tolist()]
        nothing = [None] * e
        return pa.record_batch(
            [
                pa.array(np.concatenate([unit, link_unit]), pa.int32()),
                pa.array(np.concatenate([kind, np.full(e, LINK)]), pa.int32()),
                pa.array(np.concatenate([shard, np.full(e, -1)]), pa.int32()),
                pa.array(np.concatenate([kind == SEARCHED, np.zeros(e, bool)])),
                pa.array(np.concatenate([own[at], ids[links]]), pa.int64()),
                pa.array(np.concatenate([own[at], rep_of[links]]), pa.int64()),
                pa.array([b.tobytes() for b in xs[at]] + nothing, pa.binary()),
                pa.array([copies[i] if h else None for i, h in zip(at.tolist(), held.tolist())] + nothing, pa.list_(pa.int64())),
            ],
            names=["unit", "kind", "shard", "home", "id", "rep", "vec", "copies"],
        )

    return vecs.sortWithinPartitions("id").mapInArrow(V.per_rows(work, dim), _ROUTED)


def _dealt(deal: Deal, ids: np.ndarray, home: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' places, shards, kinds and tasks: members in every copy of their part of the shard, rows to be searched for in one copy of each part."""
    part_of, copy_of = V.hashed_unit(ids, 17), V.hashed_unit(ids, 23)
    m = len(ids)
    # members, in every copy of their part; searched for in one of them
    part = (part_of * deal.divided[home]).astype("i8")
    each = deal.copies[home]
    at = np.repeat(np.arange(m), each)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    unit = deal.first[home[at]] + part[at] * deal.copies[home[at]] + copy
    kind = np.where(copy == (copy_of[at] * deal.copies[home[at]]).astype("i8"), SEARCHED, HELD)
    # guests: of all parts of the visited shards, and of the other parts of their own
    rows, shards = np.concatenate([r, np.arange(m)]), np.concatenate([s, home])
    each = deal.divided[shards]
    g = np.repeat(np.arange(len(rows)), each)
    of = np.arange(len(g)) - np.repeat(np.cumsum(each) - each, each)
    keep = (g < len(r)) | (of != part[rows[g]])
    g, of = g[keep], of[keep]
    rows, shards = rows[g], shards[g]
    guest_unit = deal.first[shards] + of * deal.copies[shards] + (copy_of[rows] * deal.copies[shards]).astype("i8")
    return np.concatenate([at, rows]), np.concatenate([home[at], shards]), np.concatenate([kind, np.full(len(rows), GUEST)]), np.concatenate([unit, guest_unit])


def _closest(homes: DataFrame, dim: int, routes: Routes) -> np.ndarray:
    """Centres x shards: the least angle of the shard's members to the centre (infinite for an empty shard)."""
    k = len(routes.centres)

    def run(batches):
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                p = b.slice(at, 1024)
                shard = p.column("shard").to_numpy()
                order = np.argsort(shard, kind="stable")
                heads = np.flatnonzero(np.diff(shard[order], prepend=-1))
                x = np.frombuffer(b"".join(p.column("vec").to_pylist()), "f4").reshape(-1, dim)[order]
                for g, v in zip(shard[order][heads].tolist(), np.maximum.reduceat(x @ routes.centres.T, heads, axis=0)):
                    best[g] = np.maximum(best[g], v) if g in best else v
        yield pa.record_batch([pa.array(list(best), pa.int32()), pa.array([v.astype("f4").tobytes() for v in best.values()], pa.binary())], names=["shard", "sims"])

    def highest(batches):
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for g, v in zip(b.column("shard").to_pylist(), b.column("sims").to_pylist()):
                v = np.frombuffer(v, "f4")
                best[g] = np.maximum(best[g], v) if g in best else v
        yield pa.record_batch([pa.array(list(best), pa.int32()), pa.array([v.tobytes() for v in best.values()], pa.binary())], names=["shard", "sims"])

    kind = "shard int, sims binary"
    out = np.full((k, routes.shards), np.inf, "f4")
    for r in homes.select("shard", "vec").mapInArrow(run, kind).repartition(4, "shard").mapInArrow(highest, kind).collect():  # one row per shard
        out[:, r["shard"]] = np.arccos(np.clip(np.frombuffer(r["sims"], "f4"), -1, 1))
    return out


def _beyond(routed: DataFrame, lists: DataFrame, dim: int, routes: Routes, n: int, k: int) -> DataFrame:
    """An exact search: what any shard holds of vectors as near as a row's ``k``-th so far."""
    spark = routed.sparkSession
    groups = min(routes.shards, max(default_parallelism(spark), math.ceil(n / GROUP_ROWS)))
    group_of = np.arange(routes.shards) * groups // routes.shards
    closest = _closest(routed.where("home"), dim, routes)
    pivots = min(PIVOTS, len(routes.centres))

    def open_rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                p = b.slice(at, 1024)
                x = np.frombuffer(b"".join(p.column("vec").to_pylist()), "f4").reshape(-1, dim)
                bound = p.column("bound").to_numpy()
                angle = np.arccos(np.clip(x @ routes.centres.T, -1, 1))
                nearest = np.argpartition(angle, pivots - 1, axis=1)[:, :pivots]
                least = (closest[nearest] - np.take_along_axis(angle, nearest, 1)[:, :, None]).max(1)
                reach = least <= np.arccos(np.clip(1 - bound, -1, 1))[:, None] + ANGLE_ERROR
                to = np.zeros((len(x), groups), bool)
                r, s = np.nonzero(reach)
                to[r, group_of[s]] = True
                r, g = np.nonzero(to)
                if len(r):
                    yield pa.record_batch([pa.array(g, pa.int32()), pa.array(np.zeros(len(r), bool)), p.column("rep").take(pa.array(r)), p.column("vec").take(pa.array(r)), pa.array(bound[r], pa.float32()), pa.nulls(len(r), pa.list_(pa.int64()))], names=["grp", "home", "id", "vec", "bound", "copies"])

    # the k-th of the different ids that a row has so far holds for its copies too
    bounds = lists.select(F.col("rep").alias("of"), F.coalesce(F.try_element_at("others", F.lit(k))["d"], F.lit(2.0)).cast("float").alias("bound"))
    homes = routed.where("home")
    asked = homes.select("rep", "vec").join(bounds, F.col("rep") == F.col("of"), "left").select("rep", "vec", F.coalesce("bound", F.lit(2.0).cast("float")).alias("bound"))
    kind = "grp int, home boolean, id long, vec binary, bound float, copies array<long>"
    grouped = (F.col("shard").cast("long") * groups / routes.shards).cast("int").alias("grp")
    both = homes.select(grouped, "home", "id", "vec", F.lit(0.0).cast("float").alias("bound"), "copies").unionByName(asked.mapInArrow(open_rows, kind))
    return both.repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", F.desc("home")).mapInArrow(_held_against(dim, k), _LISTS)


def _held_against(dim: int, k: int):
    """A function for ``mapInArrow`` over whole groups, members first: each guest's members within its bound, the ``k`` nearest vectors with all their ids."""

    def run(batches):
        grp, held, ready, guests, waiting = None, [], None, [], 0

        def settled():
            x, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[0] for h in held])
            copies = [c for h in held for c in h[2]]
            keys = np.ascontiguousarray(x).view(f"V{4 * dim}").ravel()
            _, first, node_of = np.unique(keys, return_index=True, return_inverse=True)
            several: dict[int, set[int]] = {}
            crowded = np.bincount(node_of, minlength=len(first)) > 1
            for i, c in enumerate(copies):
                if crowded[node_of[i]] or c:
                    several.setdefault(int(node_of[i]), set()).update([int(ids[i]), *(c or ())])
            nodes = np.ascontiguousarray(x[first])
            return nodes, ids[first], {n: sorted(v)[: k + 1] for n, v in several.items()}, graph.Annuli(nodes)

        def answered():
            ids, x, bound = (np.concatenate([g[j] for g in guests]) for j in range(3))
            nodes, one, several, annuli = ready
            near, sims = graph.within_bounds(nodes, annuli, x, 1 - bound - 1e-6, k + 1)
            out = []
            for r in np.flatnonzero(near[:, 0] != graph.NONE).tolist():
                got_i, got_d = [], []
                for j, s in zip(near[r].tolist(), sims[r].tolist()):
                    if j == graph.NONE:
                        break
                    some = several.get(j) or [int(one[j])]
                    got_i += some
                    got_d += [max(0.0, 1 - s)] * len(some)
                out.append((int(ids[r]), got_i, got_d))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32())))], names=["rep", "ids", "dists"])

        for b in batches:
            grps, home = b.column("grp").to_numpy(), b.column("home").to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.diff(grps * 2 + ~home, prepend=-1)), len(grps))
            for a, z in zip(cuts[:-1], cuts[1:]):
                p = b.slice(a, z - a)
                if grps[a] != grp:
                    if waiting and ready:
                        yield from answered()
                    grp, held, ready, guests, waiting = grps[a], [], None, [], 0
                x = np.frombuffer(b"".join(p.column("vec").to_pylist()), "f4").reshape(-1, dim)
                if home[a]:
                    held.append((p.column("id").to_numpy(), x, p.column("copies").to_pylist()))
                    continue
                if ready is None and held:
                    ready, held = settled(), []
                guests.append((p.column("id").to_numpy(), x, p.column("bound").to_numpy()))
                waiting += len(x)
                if ready and waiting >= 8192:
                    yield from answered()
                    guests, waiting = [], 0
        if waiting and ready:
            yield from answered()

    return run


_LISTS = "rep long, ids array<long>, dists array<float>"
#: Rows with a null list are links: ``rep`` and, as ``link``, an id with the same vector.
_ANSWERS = f"{_LISTS}, link long"


class _Shard:
    """One shard, or part of one: its members' graph, and the ids of each node."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: list, k: int):
        # one node per different vector of the members
        keys = np.ascontiguousarray(x).view(f"V{4 * x.shape[1]}").ravel() if len(x) else np.empty(0, "V4")
        _, first, self.node_of = np.unique(keys, return_index=True, return_inverse=True)
        held: dict[int, set[int]] = {}
        crowded = np.bincount(self.node_of, minlength=len(first)) > 1
        for i in range(len(ids)):
            if crowded[self.node_of[i]] or copies[i]:
                held.setdefault(int(self.node_of[i]), set()).update([int(ids[i]), *(copies[i] or ())])
        self.names = {n: sorted(v)[: k + 1] for n, v in held.items() if len(v) > 1}
        self.one = ids[first]
        order = np.argsort(self.node_of, kind="stable")
        self.members, self.first = ids[order], np.searchsorted(self.node_of[order], np.arange(len(first) + 1))
        self.several = np.zeros(len(first) + 1, bool)
        self.several[list(self.names)] = True
        self.k = k
        self.graph = graph.ShardGraph(x[first])

    def of_members(self, reps: np.ndarray, nodes: np.ndarray, within: float | None):
        """Batches of lists of the members ``reps`` at the nodes ``nodes``."""
        different, rows = np.unique(nodes, return_inverse=True)
        return self._answers(reps, rows, *self.graph.nearest(None, self.k, different), different, within)

    def of_guests(self, reps: np.ndarray, q: np.ndarray, copies: list, within: float | None):
        if within is None:
            return self._answers(reps, np.arange(len(q)), *self.graph.nearest(q, self.k), None, None)
        return self._both_ways(reps, q, copies, within)

    def _both_ways(self, reps: np.ndarray, q: np.ndarray, copies: list, within: float):
        """All members within the distance of each guest: the guests' answers, and those members' answers."""
        waiting, beam = np.arange(len(q)), graph.BEAM
        while len(waiting):
            near, sims = self.graph.nearest(q[waiting], beam, beam=beam)
            valid = (near != graph.NONE) & (np.maximum(0, 1 - sims) <= within)
            full = valid.all(1) & (beam < len(self.one))
            r, c = np.nonzero(valid & ~full[:, None])
            if len(r):
                yield self._pairs(reps[waiting[r]], [copies[i] for i in waiting[r].tolist()], near[r, c], np.maximum(0, 1 - sims[r, c]))
            waiting, beam = waiting[full], 2 * beam

    def _pairs(self, guests: np.ndarray, copies: list, nodes: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
        reps, ids, dists = [], [], []
        for g, more, node, d in zip(guests.tolist(), copies, nodes.tolist(), dist.tolist()):
            names = self.names.get(node) or [int(self.one[node])]
            reps.append(g)
            ids.append(names)
            dists.append([d] * len(names))
            own = [g, *(more or ())]
            for member in self.members[self.first[node] : self.first[node + 1]].tolist():  # one a batch at most
                reps.append(member)
                ids.append(own)
                dists.append([d] * len(own))
        return _answer(np.array(reps, "i8"), pa.array(ids, pa.list_(pa.int64())), pa.array(dists, pa.list_(pa.float32())))

    def _answers(self, reps: np.ndarray, rows: np.ndarray, near: np.ndarray, sims: np.ndarray, nodes: np.ndarray | None, within: float | None):
        k, m = self.k, len(self.one)
        dist = np.maximum(0, 1 - sims)
        valid = near != graph.NONE
        if within is not None:
            valid &= dist <= within
        slow = self.several[np.where(valid, near, m)].any(1)
        if nodes is not None:
            slow |= self.several[nodes]
        for at in range(0, len(reps), 20_000):
            some = rows[at : at + 20_000]
            own = reps[at : at + 20_000]
            plain = np.flatnonzero(~slow[some] & valid[some].any(1))
            r = some[plain]
            offsets = np.concatenate([[0], np.cumsum(valid[r].sum(1))]).astype("i4")
            yield _answer(own[plain], pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.one[near[r][valid[r]]], pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(dist[r][valid[r]], pa.float32())))
            late = []
            for j in np.flatnonzero(slow[some]).tolist():
                row = int(some[j])
                names = [] if nodes is None else self.names.get(int(nodes[row]), [])
                out_i, out_d = list(names), [0.0] * len(names)
                for c in range(k):
                    if len(out_i) > k or not valid[row, c]:
                        break
                    more = self.names.get(int(near[row, c])) or [int(self.one[near[row, c]])]
                    out_i += more
                    out_d += [float(dist[row, c])] * len(more)
                if out_i:
                    late.append((int(own[j]), out_i, out_d))
            if late:
                a, b, c = zip(*late)
                yield _answer(np.array(a), pa.array(b, pa.list_(pa.int64())), pa.array(c, pa.list_(pa.float32())))


def _answer(reps: np.ndarray, ids: pa.Array, dists: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([pa.array(reps, pa.int64()), ids, dists, pa.nulls(len(reps), pa.int64())], names=["rep", "ids", "dists", "link"])


def _listed(dim: int, k: int, within: float | None):
    """A function for ``mapInArrow`` over the rows of whole units, in order of unit and kind: the members' graph is built, then members and guests are answered."""

    def run(batches):
        unit, held, guests, waiting, shard = None, [], [], 0, None

        def settled():
            ids, x = np.concatenate([h[0] for h in held] or [np.empty(0, "i8")]), np.concatenate([h[1] for h in held] or [np.empty((0, dim), "f4")])
            return _Shard(ids, x, [c for h in held for c in h[2]], k), ids, np.concatenate([h[3] for h in held] or [np.empty(0, bool)])

        def members():
            made, ids, asked = settled()
            some = np.flatnonzero(asked)
            if len(some):
                yield from made.of_members(ids[some], made.node_of[some], within)
            return made

        def answered():
            ids, x = np.concatenate([g[0] for g in guests]), np.concatenate([g[1] for g in guests])
            yield from shard.of_guests(ids, x, [c for g in guests for c in g[2]], within)

        def closed():
            nonlocal shard
            if held:
                shard = yield from members()
            if guests and shard is not None:
                yield from answered()

        for b in batches:
            kinds, units = b.column("kind").to_numpy(), b.column("unit").to_numpy()
            stage = np.minimum(np.where(kinds == HELD, SEARCHED, kinds), LINK)
            cuts = np.append(np.flatnonzero(np.diff(units.astype("i8") * 4 + stage, prepend=-1)), len(units)) if len(units) else [0]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if units[a] != unit:
                    yield from closed()
                    unit, held, guests, waiting, shard = units[a], [], [], 0, None
                p = b.slice(a, z - a)
                if stage[a] == LINK:
                    yield pa.record_batch([p.column("rep"), pa.nulls(z - a, pa.list_(pa.int64())), pa.nulls(z - a, pa.list_(pa.float32())), p.column("id")], names=["rep", "ids", "dists", "link"])
                    continue
                x = np.frombuffer(b"".join(p.column("vec").to_pylist()), "f4").reshape(-1, dim)
                if stage[a] == SEARCHED:
                    held.append((p.column("id").to_numpy(), x, p.column("copies").to_pylist(), kinds[a:z] == SEARCHED))
                    continue
                if held:
                    shard = yield from members()
                    held = []
                guests.append((p.column("id").to_numpy(), x, p.column("copies").to_pylist()))
                waiting += len(x)
                if waiting >= 16_384 and shard is not None:
                    yield from answered()
                    guests, waiting = [], 0
        yield from closed()

    return run


def nearest_lists(df: DataFrame, id_col: str, vec_col: str, k: int = 10, visits: int | None = None, within: float | None = None, shard_rows: int = SHARD_ROWS, complete: bool = True) -> DataFrame:
    """``(id, near ARRAY<STRUCT<d, id>>)``: each id's ``k`` nearest other ids, nearest first; with ``within``, only those up to that distance (ids without any are left out).

    ``visits``: a limit on the other shards that a row visits. ``complete``: an exact search follows, unless there is a ``within``.
    """
    vecs = V.selected(df, id_col, vec_col)
    dim, n = V.dimension_and_count(vecs)
    if not n:
        return df.sparkSession.createDataFrame([], "id long, near array<struct<d:float,id:long>>")
    sample = _sampled(vecs, dim, n, SAMPLE)
    routes = _fitted(sample, dim, n, shard_rows)
    deal = _expected(sample, routes, n, visits, within, shard_rows)
    complete = complete and within is None
    routed = _routed(vecs, dim, routes, k, visits, within, deal)
    if complete:
        routed = checkpointed(routed)
    rows = routed.select("unit", "kind", "id", "rep", "vec", "copies")
    answers = checkpointed(rows.repartitionById(deal.tasks, F.col("unit")).sortWithinPartitions("unit", "kind", "id").mapInArrow(_listed(dim, k, within), _ANSWERS))
    lists, links = answers.where("ids is not null").drop("link"), answers.where("ids is null").select(F.col("link").alias("id"), F.col("rep").alias("of"))
    if complete:
        # the k + 1 nearest of different ids besides the row's own: its copies' lists have its own id too
        others = F.array_sort(F.filter("near", lambda e: e["id"] != F.col("rep")))
        once = F.filter("others", lambda e, i: F.array_position(F.transform("others", lambda o: o["id"]), e["id"]) == i + 1)
        own = F.filter("near", lambda e: e["id"] == F.col("rep"))
        first = lists.groupBy("rep").agg(_gathered()).withColumn("others", others).select("rep", F.slice(own, 1, 1).alias("own"), F.slice(once, 1, k + 1).alias("others"))
        first = checkpointed(first)
        kept = first.select("rep", F.concat("own", "others").alias("near")).select("rep", F.transform("near", lambda e: e["id"]).alias("ids"), F.transform("near", lambda e: e["d"]).alias("dists"))
        lists = kept.unionByName(_beyond(routed, first, dim, routes, n, k))
    of_copies = links.join(lists, F.col("of") == F.col("rep")).select("id", "ids", "dists")
    every = lists.select(F.col("rep").alias("id"), "ids", "dists").unionByName(of_copies)
    ordered = every.groupBy("id").agg(_gathered()).select("id", F.array_sort("near").alias("near")).withColumn("ids", F.transform("near", lambda e: e["id"]))
    # each id once, where it is nearest, and never the row's own
    other = F.filter("near", lambda e, i: (F.array_position("ids", e["id"]) == i + 1) & (e["id"] != F.col("id")))
    return ordered.select("id", F.slice(other, 1, k).alias("near")).where(F.size("near") > 0)


def _gathered():
    return F.flatten(F.collect_list(F.arrays_zip(F.col("dists").alias("d"), F.col("ids").alias("id")))).alias("near")


def _expected(sample: np.ndarray, routes: Routes, n: int, visits: int | None, within: float | None, shard_rows: int) -> Deal:
    """How the shards are dealt, by the sample's members and visitors."""
    members, guests = np.zeros(routes.shards), np.zeros(routes.shards)
    for at in range(0, len(sample), 4096):
        home, near = routes.visited(sample[at : at + 4096], visits, within, True)
        members += np.bincount(home, minlength=routes.shards)
        guests += near.sum(0)
    share = n / max(1, len(sample))
    return Deal.of(members * share, guests * share, shard_rows)


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int = 10, **how) -> DataFrame:
    """``(id, rank, near_id, dist)``: rank 1 is the nearest. Further settings as of ``nearest_lists``."""
    lists = nearest_lists(df, id_col, vec_col, k, **how)
    return lists.select("id", F.posexplode("near").alias("rank", "e")).select("id", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("near_id"), F.round(F.col("e.d").cast("double"), 6).alias("dist"))


def near_pairs(df: DataFrame, id_col: str, vec_col: str, within: float, k: int = 10, **how) -> DataFrame:
    """``(id_a, id_b)``, the smaller first: pairs within the distance of which one is among the other's ``k`` nearest."""
    lists = nearest_lists(df, id_col, vec_col, k, within=within, **how)
    pairs = lists.select("id", F.explode("near.id").alias("other"))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def recall(df: DataFrame, id_col: str, vec_col: str, found: DataFrame, k: int = 10, every: int = 20) -> float:
    """Recall at k of ``nearest`` for the ids divisible by ``every``, against brute force: each task holds the query vectors, in blocks, against its rows.

    A neighbour counts as found if the list's k-th distance is reached: ties are no misses.
    """
    vecs = V.selected(df, id_col, vec_col)
    dim, n = V.dimension_and_count(vecs)
    if not n:
        return 1.0
    asked = vecs.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id"])
    blobs = asked.mapInArrow(V.per_rows(lambda i, x: pa.record_batch([pa.array(i, pa.int64()), V.packed(x)], names=["id", "vec"]), dim), "id long, vec binary").collect()
    if not blobs:
        return 1.0
    q_ids = np.array([r["id"] for r in blobs])
    q = np.frombuffer(b"".join(bytes(r["vec"]) for r in blobs), "f4").reshape(-1, dim)

    def brute(ids: np.ndarray, x: np.ndarray):
        out = []
        for at in range(0, len(q), 1024):
            s = q[at : at + 1024] @ x.T
            s[q_ids[at : at + 1024, None] == ids[None, :]] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            v = np.take_along_axis(s, top, 1)
            out.append((np.repeat(q_ids[at : at + 1024], top.shape[1]), ids[top].ravel(), v.ravel()))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.maximum(0, 1 - c), pa.float32())], names=["id", "near_id", "d"])

    truth = vecs.dropDuplicates(["id"]).mapInArrow(V.per_rows(brute, dim), "id long, near_id long, d float").where("d < 3")
    kth = truth.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.round(F.col("d").cast("double"), 6))), 1, k).alias("ds")).select("id", F.element_at("ds", -1).alias("kth"), F.size("ds").alias("wanted"))
    hit = kth.join(found.select(F.col("id").alias("of"), "dist"), (F.col("id") == F.col("of")) & (F.col("dist") <= F.col("kth") + 2e-6), "left")
    per = hit.groupBy("id").agg(F.count("dist").alias("n"), F.max("wanted").alias("wanted"))
    return float(per.agg(F.avg(F.least(F.col("n"), F.col("wanted")) / F.col("wanted"))).first()[0])
