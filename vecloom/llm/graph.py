"""A robust-pruned directed graph over the vectors of one shard, in NumPy, and its search.

The vectors are unit vectors; similarity is the inner product, distance 1 minus it.

 1. Search: rows are searched for in blocks of similar ones. Each row has a list of the nearest
    nodes so far; the nearest entries not yet expanded are expanded, those of all rows of the
    block at once, and what their edges lead to is compared with all rows of the block in one
    matrix product. The search ends when every list is expanded. Only what is reached along
    edges, from the row's own node or from the entry nodes, is ever compared.
 2. Build: nodes are inserted in a random order, as many at a time as there are already. Each is
    searched for in the graph so far; the list that the search ends with, and the rows that are
    inserted in the same block, are its candidates.
 3. Edges: the candidates are pruned. The nearest is kept; another stays only if it is not closer,
    by the factor ``ALPHA``, to one that was kept than to the node itself. Reversed edges join, and
    what is above the degree is pruned again. Two edges are never pruned: that from the nearest node
    found when a node was inserted (its parent) to the node, so that every node can be reached, and
    that from the nearest found when it was last searched for.

Nothing else decides what is found: without edges a search finds the entry nodes only.
"""

from __future__ import annotations

import numpy as np

ALPHA = 1.2
DEGREE = 16
#: Entries of a search list while the graph is built, and when it is searched.
POOL, BEAM = 32, 32
#: A row's entries that one step expands.
WIDTH = 4
#: Nodes that are inserted first; searches for rows that are no nodes start at them.
ENTRIES = 256
#: Rows that are searched for together.
ROWS = 128
BLOCK = 512
NONE = -1


def _best(ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ``keep`` most similar ids, best first."""
    order = np.argsort(-sims, axis=1)[:, :keep]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ids[~np.isfinite(sims)] = NONE
    return ids, sims


def robust_prune(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Each row's edges out of its candidates (best first): diverse ones, at most ``degree``."""
    rows, _ = ids.shape
    points = x[np.maximum(ids, 0)]
    between = 1 - points @ points.transpose(0, 2, 1)
    alive = ids != NONE
    own = 1 - sims
    own[~alive] = np.inf
    edges = np.full((rows, degree), NONE, "i4")
    every = np.arange(rows)
    for k in range(degree):
        pick = alive.argmax(1)
        some = alive[every, pick]
        if not some.any():
            break
        edges[some, k] = ids[every, pick][some]
        alive[every, pick] = False
        alive &= ~(some[:, None] & (alpha * between[every, pick] <= own))
    return edges


class _Visits:
    """Which nodes a block's search has compared and expanded."""

    def __init__(self, nodes: int):
        self.compared, self.expanded, self._marked = (np.zeros(nodes, bool) for _ in range(3))

    def clear(self) -> None:
        self.compared[:] = False
        self.expanded[:] = False

    def different(self, nodes: np.ndarray) -> np.ndarray:
        self._marked[:] = False
        self._marked[nodes] = True
        return np.flatnonzero(self._marked)


def _joined(ids: np.ndarray, sims: np.ndarray, new: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists after the rows were compared with the nodes ``new``."""
    rows, keep = ids.shape
    r, c = np.divmod(np.flatnonzero(s > sims[:, -1:]), len(new))
    if not len(r):
        return ids, sims
    first = np.searchsorted(r, np.arange(rows))
    widest = int(np.diff(np.append(first, len(r))).max())
    if widest > 4 * keep:
        k = min(keep, len(new))
        top = np.argpartition(s, len(new) - k, axis=1)[:, len(new) - k :]
        more_i, more_s = new[top].astype("i4"), np.take_along_axis(s, top, 1)
    else:
        place = np.arange(len(r)) - first[r]
        more_i, more_s = np.full((rows, widest), NONE, "i4"), np.full((rows, widest), -np.inf, "f4")
        more_i[r, place], more_s[r, place] = new[c], s[r, c]
    return _best(np.concatenate([ids, more_i], 1), np.concatenate([sims, more_s], 1), keep)


class Edges:
    """Edges of the nodes: up to the degree from pruning, and those to their children."""

    def __init__(self, nodes: int, degree: int):
        self.pruned = np.full((nodes, degree), NONE, "i4")
        self.parent, self.nearest = (np.full(nodes, NONE, "i4") for _ in range(2))
        self.adopted()

    def adopted(self) -> None:
        """Children by parent, after ``parent`` or ``nearest`` changed."""
        parents = np.concatenate([self.parent, self.nearest])
        order = np.argsort(parents, kind="stable")
        self._children = order % max(1, len(self.parent))
        self._first = np.searchsorted(parents[order], np.arange(len(self.parent) + 1))

    def of(self, nodes: np.ndarray) -> np.ndarray:
        reached = self.pruned[nodes].ravel()
        first = self._first[nodes]
        count = self._first[nodes + 1] - first
        at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        return np.concatenate([reached[reached != NONE], self._children[at]])


def beam_search(x: np.ndarray, edges: Edges, q: np.ndarray, starts: np.ndarray, keep: int, visits: _Visits, own: np.ndarray | None = None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The lists (ids, similarities; best first) of the rows ``q``, searched for together from the nodes ``starts``; or, if the rows are nodes, from the edges of ``own``, the node of each, which its list leaves out."""
    visits.clear()
    every = np.arange(len(q))
    ids, sims = np.full((len(q), keep), NONE, "i4"), np.full((len(q), keep), -np.inf, "f4")

    def beyond(nodes: np.ndarray) -> np.ndarray:
        """The nodes that the edges of ``nodes`` lead to and that were not compared yet."""
        visits.expanded[nodes] = True
        new = visits.different(edges.of(nodes))
        return new[~visits.compared[new]]

    new = visits.different(starts) if own is None else beyond(own)
    while True:
        if len(new):
            visits.compared[new] = True
            s = q @ x[new].T
            if own is not None:
                at = np.minimum(np.searchsorted(new, own), len(new) - 1)
                itself = new[at] == own
                s[every[itself], at[itself]] = -np.inf
            ids, sims = _joined(ids, sims, new, s)
        waiting = (ids != NONE) & ~visits.expanded[ids]
        some = ids[waiting & (np.cumsum(waiting, axis=1) <= width)]
        if not len(some):
            return ids, sims
        new = beyond(visits.different(some))


def _order(x: np.ndarray) -> np.ndarray:
    """A place for each row: rows of similar direction are next to each other."""
    centres = x[: int(np.clip(np.sqrt(len(x)), 1, 512))]
    for turn in range(3):
        where = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
        if turn == 2:
            break
        order = np.argsort(where, kind="stable")
        heads = np.flatnonzero(np.diff(where[order], prepend=-1))
        total = np.zeros(centres.shape, "f8")
        total[where[order][heads]] = np.add.reduceat(x[order], heads, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres).astype("f4")
    near = np.einsum("ij,ij->i", x, centres[where])
    place = np.empty(len(x), "i8")
    place[np.lexsort((-near, where))] = np.arange(len(x))
    return place


class ShardGraph:
    """The graph over the members of a shard."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, pool: int = POOL, seed: int = 1):
        self.places = np.random.default_rng(seed).permutation(len(x))  # the member of each node
        self.nodes = np.argsort(self.places)
        self.x = np.ascontiguousarray(x[self.places])
        self.edges = Edges(len(x), degree)
        self.entries = np.arange(min(ENTRIES, len(x)))
        self.order = _order(self.x) if len(x) else np.empty(0, "i8")
        done = 0
        while done < len(x):
            upto = min(len(x), max(2 * done, ENTRIES))
            self._insert(done, upto, pool)
            done = upto

    def _insert(self, done: int, upto: int, pool: int) -> None:
        rows = np.arange(done, upto)
        rows = rows[np.argsort(self.order[rows])]
        visits, chosen = _Visits(done), []
        for a in range(0, len(rows), ROWS):
            own = rows[a : a + ROWS]
            q = self.x[own]
            beside = own if done else rows
            ids, sims = beam_search(self.x, self.edges, q, self.entries, pool, visits) if done else (np.empty((len(own), 0), "i4"), np.empty((len(own), 0), "f4"))
            if done:
                self.edges.parent[own] = ids[:, 0]
            s = q @ self.x[beside].T
            s[own[:, None] == beside[None, :]] = -np.inf
            ids, sims = _best(np.concatenate([ids, np.broadcast_to(beside.astype("i4"), s.shape)], 1), np.concatenate([sims, s], 1), pool)
            chosen.append(robust_prune(self.x, ids, sims, self.edges.pruned.shape[1]))
        self.edges.adopted()
        self._link(rows, np.concatenate(chosen))

    def _link(self, src: np.ndarray, chosen: np.ndarray) -> None:
        """Gives ``src`` their edges and adds the reversed ones; nodes with too many are pruned."""
        x, edges, degree = self.x, self.edges.pruned, self.edges.pruned.shape[1]
        edges[src] = chosen
        r, c = np.nonzero(chosen != NONE)
        touched = np.unique(chosen[r, c])
        if not len(touched):
            return
        have_r, have_c = np.nonzero(edges[touched] != NONE)
        a = np.concatenate([touched[have_r], chosen[r, c]]).astype("i8")
        b = np.concatenate([edges[touched[have_r], have_c], src[r]])
        pairs = np.sort(a * len(x) + b)
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        a, b = np.divmod(pairs, len(x))
        b = b.astype("i4")
        s = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        first = np.searchsorted(a, touched)
        count = np.diff(np.append(first, len(a)))
        width = max(degree, min(int(count.max()), 3 * degree))
        row, place = np.repeat(np.arange(len(touched)), count), np.arange(len(a)) - np.repeat(first, count)
        held = place < width
        ids, sims = np.full((len(touched), width), NONE, "i4"), np.full((len(touched), width), -np.inf, "f4")
        ids[row[held], place[held]], sims[row[held], place[held]] = b[held], s[held]
        edges[touched] = ids[:, :degree]
        over = np.flatnonzero(count > degree)
        for i in range(0, len(over), BLOCK):
            some = over[i : i + BLOCK]
            edges[touched[some]] = robust_prune(x, ids[some], sims[some], degree)

    def nearest(self, q: np.ndarray | None, k: int, members: np.ndarray | None = None, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar members (places, -1 for none) of each row of ``q`` and the similarities; without ``q``, of each of ``members`` (default: all)."""
        if q is None:
            own_of = self.nodes if members is None else self.nodes[members]
            q = self.x[own_of]
            order = np.argsort(self.order[own_of])
        else:
            own_of, order = None, np.argsort(_order(q)) if len(q) else np.empty(0, "i8")
        keep = max(beam, k)
        out_i, out_s = np.full((len(q), k), NONE, "i4"), np.full((len(q), k), -np.inf, "f4")
        if not len(self.x):
            return out_i, out_s
        visits = _Visits(len(self.x))
        for a in range(0, len(q), ROWS):
            some = order[a : a + ROWS]
            own = None if own_of is None else own_of[some]
            ids, sims = beam_search(self.x, self.edges, q[some], self.entries, keep, visits, own)
            if own is not None:
                self.edges.nearest[own] = ids[:, 0]
            out_i[some], out_s[some] = np.where(ids[:, :k] == NONE, NONE, self.places[ids[:, :k]]), sims[:, :k]
        if own_of is not None:
            self.edges.adopted()
        return out_i, out_s


def shard_neighbours(x: np.ndarray, members: int, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``x`` (members first, then visitors) its ``k`` most similar members: ids (places among the members, -1 for none) and similarities."""
    built = ShardGraph(x[:members])
    a, b = built.nearest(None, k, beam=beam), built.nearest(x[members:], k, beam=beam)
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])


class Annuli:
    """Vectors in blocks of similar direction and distance from a centre, with bounds on the angle of any row to them: for an exact search that follows."""

    def __init__(self, x: np.ndarray, block: int = 256, seed: int = 5):
        rng = np.random.default_rng(seed)
        k = int(np.clip(np.sqrt(len(x)), 1, 512))
        centres = x[rng.choice(len(x), k, replace=False)]
        for turn in range(3):
            where = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
            if turn == 2:
                break
            total = np.zeros(centres.shape)
            order = np.argsort(where, kind="stable")
            heads = np.flatnonzero(np.diff(where[order], prepend=-1))
            total[where[order][heads]] = np.add.reduceat(x[order], heads, axis=0)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres).astype("f4")
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, centres[where]), -1, 1))
        order = np.lexsort((angle, where))
        self.centres, self.blocks, self.of, near, far = centres, [], [], [], []
        cuts = np.append(np.flatnonzero(np.diff(where[order], prepend=-1)), len(x))
        for a, z in zip(cuts[:-1], cuts[1:]):
            for b in range(a, z, block):
                rows = order[b : min(b + block, z)]
                self.blocks.append(rows)
                self.of.append(where[rows[0]])
                near.append(angle[rows[0]])
                far.append(angle[rows[-1]])
        self.of, self.near, self.far = np.array(self.of), np.array(near, "f4"), np.array(far, "f4")

    def reachable(self, x: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Rows x blocks: whether a block may hold a member more similar to the row than ``worst``."""
        at = np.arccos(np.clip(x @ self.centres.T, -1, 1))[:, self.of]
        least = np.maximum(np.maximum(at - self.far, self.near - at), 0)
        return least <= np.arccos(np.clip(worst, -1, 1))[:, None] + 1e-3


def within_bounds(own: np.ndarray, annuli: Annuli, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``x``: its ``k`` most similar members of those with a similarity above the row's ``least``, best first."""
    ids, sims = np.full((len(x), k), NONE, "i4"), np.full((len(x), k), -np.inf, "f4")
    for at in range(0, len(x), 8192):
        xs, worst = x[at : at + 8192], least[at : at + 8192].astype("f4")
        reach = annuli.reachable(xs, worst)
        for b, block in enumerate(annuli.blocks):
            r = np.flatnonzero(reach[:, b])
            if not len(r):
                continue
            s = xs[r] @ own[block].T
            hit = (s > worst[r, None]).any(1)
            if not hit.any():
                continue
            r, s = r[hit], s[hit]
            s[s <= worst[r, None]] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            i = np.concatenate([ids[at + r], block[top].astype("i4")], 1)
            v = np.concatenate([sims[at + r], np.take_along_axis(s, top, 1)], 1)
            i[~np.isfinite(v)] = NONE
            order = np.lexsort((i, -v), axis=1)[:, :k]
            ids[at + r], sims[at + r] = np.take_along_axis(i, order, 1), np.take_along_axis(v, order, 1)
            worst[r] = np.maximum(worst[r], sims[at + r, -1] - 1e-6)
    return ids, sims
