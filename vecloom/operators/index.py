"""A layered index over a DataFrame of vectors.

Elements are spread over shards of about ``SHARD_ROWS`` by a hash of the id (one shard while
there are no more: then the layers are those of the whole). Each shard has a layered graph of
its own; a search asks every shard and merges the best. A shard is one task, and what is sent
to the tasks are blocks of queries, never the graph.

The tables: ``elements(id, vec)`` and ``graph(shard, layer, node, neighbors)``, nodes and
neighbours by element id, neighbours ordered by id. On disk an index is a directory with both
as parquet (the graph partitioned by layer) and a header.

Ids must be unique and not null; vectors must be of one length. An empty table gives an index
without layers, and searches of it nothing.
"""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from vecloom.operators import exact
from vecloom.operators.layered import NONE, BuildConfig, Searcher, build
from vecloom.schemas import GRAPH, element_type

SHARD_ROWS = 16_384
LIBRARY, VERSION = "vecloom", 2


class HasGraph(Protocol):
    """What an index and a builder have in common."""

    def num_layers(self) -> int: ...
    def layer_len(self, layer: int) -> int: ...
    def get_neighbors(self, node: int, layer: int | None = None) -> list[int]: ...


def _shard(shards: int):
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


_ROWS = "shard int, layer int, id long, neighbors array<long>, vec array<float>"


#: The layer under which queries come, after all others.
QUERY = 1 << 20


def _together(elements: DataFrame, graph: DataFrame | None, shards: int, queries: DataFrame | None = None) -> DataFrame:
    """Elements (layer -1) and graph rows, those of a shard in one partition; and all queries ``(id, vec)``, after them, in each."""
    rows = elements.select(_shard(shards).alias("shard"), F.lit(-1).alias("layer"), "id", F.lit(None).cast("array<long>").alias("neighbors"), F.col("vec").cast("array<float>").alias("vec"))
    if graph is not None:
        rows = rows.unionByName(graph.select("shard", "layer", F.col("node").alias("id"), "neighbors", F.lit(None).cast("array<float>").alias("vec")))
    if queries is not None:
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        rows = rows.unionByName(queries.select(every, F.lit(QUERY).alias("layer"), "id", F.lit(None).cast("array<long>").alias("neighbors"), F.col("vec").cast("array<float>").alias("vec")))
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "layer", "id")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]] | pa.RecordBatch]:
    """Each shard's ids, unit vectors and layers (places of neighbours); if there are queries, followed by batches of them."""

    def made(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        layer, ids = t.column("layer").to_numpy(), t.column("id").to_numpy()
        n = int((layer == -1).sum())
        own = ids[:n]
        vecs = t.column("vec").slice(0, n).combine_chunks()
        vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
        dim = len(vecs[0]) if n else 0
        x = exact.unit(exact.matrix(vecs, dim)) if n else np.empty((0, 0))
        layers = []
        for k in range(int(layer.max()) + 1 if len(layer) else 0):
            at = np.flatnonzero(layer == k)
            lists = t.column("neighbors").slice(int(at[0]), len(at)).to_pylist() if len(at) else []
            width = max([1, *map(len, lists)])
            rows = np.full((len(at), width), NONE, "i4")
            for r, some in enumerate(lists):
                rows[r, : len(some)] = np.searchsorted(own, some)
            layers.append(rows)
        return own, x, layers

    shard, parts = None, []
    for b in batches:
        shards, asked = b.column("shard").to_numpy(), b.column("layer").to_numpy() == QUERY
        cuts = np.append(np.flatnonzero(np.diff(shards.astype("i8") * 2 + asked, prepend=-1)), len(shards)) if len(shards) else [0]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if parts and (shards[a] != shard or asked[a]):
                yield shard, *made(parts)
                parts = []
            elif asked[a] and shards[a] != shard:  # a shard without elements
                yield int(shards[a]), np.empty(0, "i8"), np.empty((0, 0)), []
            shard = int(shards[a])
            if asked[a]:
                yield b.slice(a, z - a)
            else:
                parts.append(b.slice(a, z - a))
    if parts:
        yield shard, *made(parts)


def _graph_rows(shard: int, ids: np.ndarray, layers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, layer in enumerate(layers):
        for at in range(0, len(layer), 4096):
            rows = layer[at : at + 4096]
            lists = [np.sort(ids[r[r != NONE]]) for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in lists])]).astype("i4")
            flat = np.concatenate(lists) if lists else np.empty(0, "i8")
            m = len(rows)
            yield pa.record_batch([pa.array(np.full(m, shard, "i4")), pa.array(np.full(m, k, "i4")), pa.array(ids[at : at + m]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], names=["shard", "layer", "node", "neighbors"])


@dataclasses.dataclass
class Index:
    """Elements and graph; searchable."""

    elements: DataFrame
    graph: DataFrame
    shards: int
    kind: str = "angular"
    config: BuildConfig = dataclasses.field(default_factory=BuildConfig)

    # --- looking things up

    def num_layers(self) -> int:
        top = self.graph.agg(F.max("layer")).first()[0]
        return 0 if top is None else top + 1

    def layer_counts(self) -> list[int]:
        return [r["n"] for r in self.graph.groupBy("layer").agg(F.count("*").alias("n")).orderBy("layer").collect()]

    def layer_len(self, layer: int) -> int:
        return self.graph.where(F.col("layer") == layer).count()

    def __len__(self) -> int:
        """Indexed elements: those of each shard's last layer."""
        return self.last_layer().count()

    def num_elements(self) -> int:
        return self.elements.count()

    def last_layer(self) -> DataFrame:
        tops = self.graph.groupBy(F.col("shard").alias("of")).agg(F.max("layer").alias("top"))
        return self.graph.join(tops, (F.col("shard") == F.col("of")) & (F.col("layer") == F.col("top"))).select("shard", "layer", "node", "neighbors")

    def get_element(self, idx: int) -> list[float] | None:
        row = self.elements.where(F.col("id") == idx).select("vec").first()
        return row and list(row[0])

    def get_neighbors(self, node: int, layer: int | None = None) -> list[int]:
        rows = self.graph.where(F.col("node") == node)
        if layer is not None:
            rows = rows.where(F.col("layer") == layer)
        row = rows.orderBy(F.desc("layer")).select("neighbors").first()
        return list(row[0]) if row else []

    # --- searching

    def search(self, queries: DataFrame, max_search: int = 200, k: int = 10, query_id: str = "query_id", query_vec: str = "vec") -> DataFrame:
        """``(query_id, rank, id, dist)`` by beam search in every shard; at most ``min(k, max_search)`` rows a query."""
        if max_search < 1:
            raise ValueError("max_search must be at least 1")
        k = min(k, max_search)
        wanted = exact.asked(queries, query_id, query_vec)
        rows = _together(self.elements, self.graph, self.shards, wanted)

        def run(batches):
            searcher, own = None, None
            for part in _shards(batches):
                if isinstance(part, tuple):
                    _, own, x, layers = part
                    searcher = Searcher(x, layers) if len(own) else None
                elif searcher is not None:
                    q = exact.unit(exact.matrix(part.column("vec"), searcher.x.shape[1]))
                    ids, dist = searcher.search_block(q, max_search, k)
                    r, c = np.nonzero(ids != NONE)
                    if len(r):
                        yield pa.record_batch([part.column("id").take(pa.array(r)), pa.array(own[ids[r, c]], pa.int64()), pa.array(dist[r, c])], names=["query_id", "id", "dist"])

        return exact.merged_top(rows.mapInArrow(run, "query_id long, id long, dist double"), k)

    def trails(self) -> DataFrame:
        """``(id, trail)``: the elements that greedy search for each element passes in the upper layers."""

        def run(batches):
            for _, own, x, layers in _shards(batches):
                searcher = Searcher(x, layers)
                out = [own[searcher.trail(v)].tolist() for v in x]
                yield pa.record_batch([pa.array(own), pa.array(out, pa.list_(pa.int64()))], names=["id", "trail"])

        return _together(self.elements, self.graph, self.shards).mapInArrow(run, "id long, trail array<long>")

    # --- storing

    def header(self) -> dict:
        counts = self.layer_counts()
        return {"library": LIBRARY, "version": VERSION, "num_elements": len(self), "num_layers": len(counts), "layer_counts": counts, "num_neighbors": self.config.num_neighbors, "shards": self.shards, "element_type": self.kind, "config": dataclasses.asdict(self.config)}

    def save(self, path: str) -> None:
        """Writes header, graph and elements below ``path``, replacing what is there."""
        spark = self.elements.sparkSession
        self.graph.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/graph")
        self.elements.write.mode("overwrite").parquet(f"{path}/elements")
        spark.createDataFrame([(json.dumps(self.header()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta.get("library") != LIBRARY or meta.get("version") != VERSION:
            raise ValueError(f"no index of this library and version {VERSION}: {path}")
        if meta["num_layers"] != len(meta["layer_counts"]):
            raise ValueError("the header does not fit its layers")
        graph = spark.read.schema(GRAPH).parquet(f"{path}/graph") if meta["num_layers"] else spark.createDataFrame([], GRAPH)
        return Index(spark.read.parquet(f"{path}/elements"), graph.select("shard", "layer", "node", "neighbors"), meta["shards"], meta["element_type"], BuildConfig(**meta["config"]))


class IndexBuilder:
    """Elements and a growing graph."""

    def __init__(self, elements: DataFrame, config: BuildConfig | None = None, kind: str = "angular", id_col: str = "id", vec_col: str = "vec", shards: int | None = None, graph: DataFrame | None = None):
        self.kind = element_type(kind)
        self.config = config or BuildConfig()
        self.elements = elements.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
        self.given_shards = shards
        self.graph = graph

    @staticmethod
    def resume(index: Index, config: BuildConfig | None = None) -> IndexBuilder:
        """A builder on an index; with a smaller degree the stored lists keep their smallest ids."""
        config = config or index.config
        graph = index.graph.withColumn("neighbors", F.slice(F.array_sort("neighbors"), 1, config.num_neighbors))
        return IndexBuilder(index.elements, config, index.kind, shards=index.shards, graph=graph)

    @property
    def shards(self) -> int:
        if self.given_shards is None:
            expected = max(self.config.expected or 0, self.elements.count())
            self.given_shards = max(1, math.ceil(expected / SHARD_ROWS))
        return self.given_shards

    def append(self, more: DataFrame, id_col: str = "id", vec_col: str = "vec") -> IndexBuilder:
        """Adds elements (under ids of their own), unindexed until the next build."""
        self.shards  # the elements there are fix the number of shards
        self.elements = self.elements.unionByName(more.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")))
        return self

    def build(self) -> Index:
        return self.build_partial(None)

    def build_partial(self, num_elements: int | None) -> Index:
        """Indexes the elements with the smallest ids, that many in all (or as many as are indexed already); None: all; 0: none."""
        from vecloom.session import checkpointed

        if num_elements == 0:
            graph = self.graph if self.graph is not None else self.elements.sparkSession.createDataFrame([], GRAPH)
            return Index(self.elements, graph, self.shards, self.kind, self.config)
        config, shards = self.config, self.shards
        if config.expected:
            config = dataclasses.replace(config, expected=math.ceil(config.expected / shards))

        last = None if num_elements is None else self._last_of(num_elements)

        def run(batches):
            for shard, own, x, layers in _shards(batches):
                upto = None if last is None else max(len(layers[-1]) if layers else 0, int(np.searchsorted(own, last, side="right")))
                yield from _graph_rows(shard, own, build(x, config, layers, upto))

        self.graph = checkpointed(_together(self.elements, self.graph, shards).mapInArrow(run, GRAPH))
        return Index(self.elements, self.graph, shards, self.kind, self.config)

    def _last_of(self, n: int) -> int:
        """The id that ``n`` elements do not exceed, found by halving: each step is a count."""
        low, high = self.elements.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return 0
        while low < high:
            middle = (low + high) // 2
            if self.elements.where(F.col("id") <= middle).count() >= n:
                high = middle
            else:
                low = middle + 1
        return low

    def get_index(self) -> Index:
        graph = self.graph if self.graph is not None else self.elements.sparkSession.createDataFrame([], GRAPH)
        return Index(self.elements, graph, self.shards, self.kind, self.config)


def neighbour_invariants(index: Index) -> DataFrame:
    """``(layer, nodes, edges, loops, over_degree, dangling)``: what must hold of a graph, layer by layer."""
    g = index.graph
    edges = g.select("shard", "layer", "node", F.explode("neighbors").alias("nbr"))
    known = g.select(F.col("shard").alias("s"), F.col("layer").alias("l"), F.col("node").alias("n"))
    hung = edges.join(known, (F.col("shard") == F.col("s")) & (F.col("layer") == F.col("l")) & (F.col("nbr") == F.col("n")), "left_anti").groupBy("layer").agg(F.count("*").alias("dangling"))
    per = g.groupBy("layer").agg(
        F.count("*").alias("nodes"),
        F.sum(F.size("neighbors")).alias("edges"),
        F.sum(F.array_contains("neighbors", F.col("node")).cast("long")).alias("loops"),
        F.sum((F.size("neighbors") > index.config.num_neighbors).cast("long")).alias("over_degree"),
    )
    return per.join(hung, "layer", "left").select("layer", "nodes", "edges", "loops", "over_degree", F.coalesce("dangling", F.lit(0)).cast("long").alias("dangling"))


