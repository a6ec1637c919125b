"""The layered graph of one shard, in NumPy: built layer by layer, extended, searched.

Layer i holds the elements at places 0 to its size; the last layer holds all. A layer begins
with the edges of the one above. All its new elements get their candidates at once, the nearest
linked elements of the layer; each keeps a diverse choice of them, and edges go both ways, so
that the outcome does not depend on any order of threads. Shards are of bounded size (see
``index``), so that the candidates come from blocked matrix products.

An element is left without edges if it is not near itself (a zero vector), or if the choice's
middle one is a duplicate of it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from vecloom.functions.vector import EPSILON_100, elements_in_layer

NONE = -1


@dataclass(frozen=True)
class BuildConfig:
    """Settings of a build. ``max_search``: candidates of an element; ``expected``: elements that there will be at last."""

    layer_multiplier: float = 15.0
    expected: int | None = None
    num_neighbors: int = 30
    max_search: int = 200
    reinsert: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.num_neighbors < 255:
            raise ValueError("num_neighbors must be between 1 and 254")
        if self.max_search < 1:
            raise ValueError("max_search must be at least 1")
        if not self.layer_multiplier > 1:
            raise ValueError("layer_multiplier must be above 1")


def select(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, limit: int) -> np.ndarray:
    """A diverse choice out of each row's candidates (sorted by distance, -1 beyond the end): all, if there are at most ``limit``."""
    rows, width = ids.shape
    out = np.full((rows, limit), NONE, "i4")
    held = ids != NONE
    few = held.sum(1) <= limit
    w = min(width, limit)
    out[few, :w] = ids[few, :w]
    rest = np.flatnonzero(~few)
    every = np.arange(len(rest))
    if not len(rest):
        return out
    ids, dist, alive = ids[rest], dist[rest], held[rest]
    points = x[np.maximum(ids, 0)]
    between = np.maximum(0, 1 - points @ points.transpose(0, 2, 1))
    for k in range(limit):
        pick = alive.argmax(1)
        some = alive[every, pick]
        if not some.any():
            break
        out[rest[some], k] = ids[every, pick][some]
        alive[every, pick] = False
        alive &= ~(some[:, None] & (dist > between[every, pick]))
    return out


def _candidates(x: np.ndarray, rows: np.ndarray, among: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``among`` for each of ``rows``, itself left out, by (distance, place)."""
    d = np.maximum(0, 1 - x[rows] @ x[among].T)
    d[rows[:, None] == among[None, :]] = np.inf
    most = min(most, len(among))
    if d.shape[1] > most:
        top = np.argpartition(d, most - 1, axis=1)[:, :most]
    else:
        top = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    ids, dist = among[top].astype("i4"), np.take_along_axis(d, top, 1)
    order = np.lexsort((ids, dist), axis=1)
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    ids[~np.isfinite(dist)] = NONE
    return ids, dist


def _joined(x: np.ndarray, size: int, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Edges as rows of at most ``width``; where there are more, a diverse choice of the nearest."""
    pairs = np.unique(a.astype("i8") * size + b)
    a, b = (pairs // size).astype("i4"), (pairs % size).astype("i4")
    d = np.concatenate([np.maximum(0, 1 - np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]])) for i in range(0, len(a), 65536)] or [np.empty(0, x.dtype)])
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    most = int(min(place.max() + 1 if len(a) else 1, 4 * width))
    held = place < most
    ids, dist = np.full((size, most), NONE, "i4"), np.full((size, most), np.inf)
    ids[a[held], place[held]], dist[a[held], place[held]] = b[held], d[held]
    out = np.empty((size, width), "i4")
    for at in range(0, size, 256):
        out[at : at + 256] = select(x, ids[at : at + 256], dist[at : at + 256], width)
    return out


def _link(x: np.ndarray, old: np.ndarray, size: int, config: BuildConfig, degree: int) -> np.ndarray:
    """A layer grown to ``size`` elements: ``old`` are the rows it has."""
    before = len(old)
    points = x[:size]
    good = np.einsum("ij,ij->i", points, points) > 1 - EPSILON_100
    among = np.flatnonzero(good)
    a, b = [], []
    src, col = np.nonzero(old != NONE)
    a.append(src.astype("i4"))
    b.append(old[src, col])
    half = max(1, config.max_search // 2)
    rows = np.arange(0 if config.reinsert else before, size)
    rows = rows[good[rows]]
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        ids, dist = _candidates(points, some, among, config.max_search)
        new = some >= before
        # elements that are new are inserted; then all are inserted again with half of the candidates
        passes = [(some[new], ids[new], dist[new])]
        if config.reinsert:
            passes.append((some, ids[:, :half], dist[:, :half]))
        for own, near, far in passes:
            chosen = select(points, near, far, degree)
            middle = chosen[:, min(degree // 2, chosen.shape[1] - 1)]
            d = np.maximum(0, 1 - np.einsum("ij,ij->i", points[own], points[np.maximum(middle, 0)]))
            chosen[(middle != NONE) & (d < EPSILON_100)] = NONE
            r, c = np.nonzero(chosen != NONE)
            i, j = own[r].astype("i4"), chosen[r, c]
            a += [i, j]
            b += [j, i]
    return _joined(points, size, np.concatenate(a), np.concatenate(b), degree)


def build(x: np.ndarray, config: BuildConfig, layers: list[np.ndarray] | None = None, upto: int | None = None) -> list[np.ndarray]:
    """The layers (rows of neighbours, -1 beyond the end) over unit vectors ``x``; ``layers`` are extended. ``upto``: elements to index."""
    layers = list(layers or [])
    n = len(x) if upto is None else upto
    have = len(layers[-1]) if layers else 0
    if not have <= n <= len(x):
        raise ValueError("cannot index fewer elements than are indexed, or more than there are")
    total = max(config.expected or 0, len(x))
    while n and (not layers or len(layers[-1]) < n):
        if layers:
            at = len(layers) - 1
            size = min(elements_in_layer(total, config.layer_multiplier, at), n)
            if size > len(layers[at]):
                layers[at] = _grown(x, layers[at], size, config, total)
                continue
        at = len(layers)
        start = layers[-1] if layers else np.empty((0, 1), "i4")
        size = min(elements_in_layer(total, config.layer_multiplier, at), n)
        layers.append(_grown(x, start, max(size, len(start)), config, total))
    return layers


def _grown(x: np.ndarray, old: np.ndarray, size: int, config: BuildConfig, total: int) -> np.ndarray:
    degree = config.num_neighbors if size >= total else max(1, config.num_neighbors // 2)
    return _link(x, old, size, config, degree)


#: Queries that are searched for together, and entries of a query's list that one step expands.
TOGETHER, WIDTH = 128, 8


class Searcher:
    """Searches one shard: greedy through the upper layers, then best-first in the last.

    ``search`` takes one query, ``search_block`` many: the nodes that the expansions of a block of
    queries lead to are compared with all queries of the block in one matrix product, so that a query's
    list is that of a search of its own, or better.
    """

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x = x
        self.rows = layers
        self._lists: list[list[np.ndarray]] | None = None
        good = np.flatnonzero(np.einsum("ij,ij->i", x, x) > 1 - EPSILON_100)
        self.entry = int(good[0]) if len(good) else 0

    @property
    def layers(self) -> list[list[np.ndarray]]:
        if self._lists is None:
            self._lists = [[row[row != NONE] for row in layer] for layer in self.rows]
        return self._lists

    def search_block(self, q: np.ndarray, max_search: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1 beyond the end) and distances of at most ``min(k, max_search)`` elements for each query, nearest first."""
        if max_search < 1:
            raise ValueError("max_search must be at least 1")
        k = min(k, max_search)
        ids, dist = np.full((len(q), k), NONE, "i8"), np.full((len(q), k), np.inf)
        if not self.rows or not len(self.rows[-1]):
            return ids, dist
        for a in range(0, len(q), TOGETHER):
            some = q[a : a + TOGETHER]
            at = np.full(len(some), self.entry)
            for layer in self.rows[:-1]:
                at = self._together(layer, np.where(at < len(layer), at, 0), some, 1)[0][:, 0]
            i, d = self._together(self.rows[-1], np.where(at < len(self.rows[-1]), at, 0), some, min(max_search, len(self.rows[-1])))
            ids[a : a + len(some), : i.shape[1]], dist[a : a + len(some), : i.shape[1]] = i[:, :k], d[:, :k]
        return ids, dist

    def _together(self, layer: np.ndarray, starts: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        compared, expanded = np.zeros(len(layer), bool), np.zeros(len(layer), bool)
        ids, dist = np.full((len(q), most), NONE, "i8"), np.full((len(q), most), np.inf)
        new = np.unique(starts)
        while True:
            if len(new):
                compared[new] = True
                d = np.maximum(0, 1 - q @ self.x[new].T)
                i, d = np.concatenate([ids, np.broadcast_to(new, d.shape)], 1), np.concatenate([dist, d], 1)
                order = np.lexsort((i, d), axis=1)[:, :most]
                ids, dist = np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1)
            waiting = (ids != NONE) & ~expanded[ids]
            some = np.unique(ids[waiting & (np.cumsum(waiting, axis=1) <= WIDTH)])
            if not len(some):
                return ids, dist
            expanded[some] = True
            new = np.unique(layer[some])
            new = new[(new != NONE) & ~compared[new]]

    def _beam(self, layer: list[np.ndarray], start: int, q: np.ndarray, most: int) -> list[tuple[float, int]]:
        x = self.x
        d = max(0.0, 1 - float(x[start] @ q))
        todo, best, seen = [(d, start)], [(-d, -start)], {start}
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= most and d > -best[0][0]:
                break
            new = [j for j in layer[node].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(np.maximum(0, 1 - x[new] @ q).tolist(), new):
                if len(best) < most or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, -j))
                    if len(best) > most:
                        heapq.heappop(best)
        return sorted((-e, -j) for e, j in best)

    def trail(self, q: np.ndarray, upto: int | None = None, most: int = 1) -> list[int]:
        """The nearest element that greedy search finds in each upper layer."""
        at, out = self.entry, []
        for layer in self.layers[: len(self.layers) - 1 if upto is None else upto]:
            if at >= len(layer):
                at = 0
            at = self._beam(layer, at, q, most)[0][1]
            out.append(at)
        return out

    def search(self, q: np.ndarray, max_search: int, k: int) -> list[tuple[float, int]]:
        """At most ``min(k, max_search)`` (distance, place), nearest first."""
        if max_search < 1:
            raise ValueError("max_search must be at least 1")
        if not self.layers or not len(self.layers[-1]):
            return []
        trail = self.trail(q)
        return self._beam(self.layers[-1], trail[-1] if trail else self.entry, q, max_search)[:k]
