"""Renumbering of an index: permutations, orders, and what they do to elements and graphs.

A permutation is a table ``(new_id, old_id)``: the element ``old_id`` becomes ``new_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.ids import numbered


def reverse_mapping(perm: DataFrame) -> DataFrame:
    """The inverse permutation."""
    return perm.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("old_id"))


def permuted(elements: DataFrame, perm: DataFrame, id_col: str = "id") -> DataFrame:
    """The elements under their new ids."""
    moved = elements.join(perm, F.col(id_col) == F.col("old_id"))
    return moved.drop(id_col, "old_id").withColumnRenamed("new_id", id_col).select(*elements.columns)


def layer_bands(elements: DataFrame, sizes: list[int], id_col: str = "id") -> DataFrame:
    """The elements with ``band``: the first layer that has them. Sizes are those of the layers, ids dense from 0."""
    band = F.lit(len(sizes))
    for k in reversed(range(len(sizes))):
        band = F.when(F.col(id_col) < sizes[k], F.lit(k)).otherwise(band)
    return elements.withColumn("band", band)


def order_by_keys(keys: DataFrame, sizes: list[int], id_col: str = "id", key_col: str = "key") -> DataFrame:
    """The permutation that sorts by (band, key, id): layers keep their elements. Keys are of any type that can be ordered."""
    banded = layer_bands(keys.select(F.col(id_col).alias("old_id"), F.col(key_col).alias("key")), sizes, "old_id")
    return numbered(banded, "new_id", 0, ["band", "key", "old_id"]).select("new_id", "old_id")


def reordered_graph(graph: DataFrame, perm: DataFrame) -> DataFrame:
    """The graph under the new ids, neighbours ordered by them."""
    others = [c for c in graph.columns if c not in ("node", "neighbors")]
    to_new = perm.select(F.col("old_id").alias("was"), F.col("new_id").alias("now"))
    edges = graph.select(*others, "node", F.explode_outer("neighbors").alias("nbr"))
    moved = edges.join(to_new, F.col("nbr") == F.col("was"), "left").drop("was").withColumnRenamed("now", "new_nbr")
    lists = moved.groupBy(*others, "node").agg(F.array_sort(F.collect_list("new_nbr")).alias("neighbors"))
    return lists.join(to_new, F.col("node") == F.col("was")).select(*others, F.col("now").alias("node"), "neighbors")


def norm_keys(terms: DataFrame, norms: DataFrame, length: int = 8, id_col: str = "id", terms_col: str = "term_ids") -> DataFrame:
    """``(id, key)``: each element's term ids by falling norm of their embedding (ties: later places first), the first ``length``, padded with 0.

    ``norms``: ``(word_id, norm)``. Terms without a norm are left out.
    """
    placed = terms.select(F.col(id_col).alias("id"), F.posexplode_outer(terms_col).alias("pos", "term"))
    known = placed.join(norms.select("word_id", "norm"), F.col("term") == F.col("word_id"), "left")
    ranked = known.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("norm").isNotNull(), F.struct((-F.col("norm")).alias("a"), (-F.col("pos")).alias("b"), F.col("term").alias("t"))))).alias("r"))
    ids = F.transform("r", lambda e: e["t"])
    return ranked.select("id", F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("int"), length)), 1, length).alias("key"))


def order_within_shards(index, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """The permutation that sorts by (band, key, id) within each shard: the ids of a shard stay its ids, and the layers their elements."""
    from vecloom.operators.index import _shard

    bands = index.graph.groupBy(F.col("node").alias("n")).agg(F.min("layer").alias("band"))
    rows = keys.select("id", F.col(key_col).alias("key")).join(bands, F.col("id") == F.col("n"), "left")
    rows = rows.select("id", "key", F.coalesce("band", F.lit(1 << 20)).alias("band"), _shard(index.shards).alias("shard"))
    by_id, by_key = Window.partitionBy("shard").orderBy("id"), Window.partitionBy("shard").orderBy("band", "key", "id")  # a shard is bounded
    placed = rows.select("id", "shard", F.row_number().over(by_id).alias("place"), F.row_number().over(by_key).alias("to"))
    slots = placed.select(F.col("shard").alias("s"), F.col("place").alias("p"), F.col("id").alias("new_id"))
    return placed.join(slots, (F.col("shard") == F.col("s")) & (F.col("to") == F.col("p"))).select("new_id", F.col("id").alias("old_id"))


def reordered_index(index, keys: DataFrame | None = None):
    """An index reordered by keys ``(id, key)``, by default by the trail of each element through the upper layers; and the permutation.

    With several shards each is reordered by itself: an element stays in its shard.
    """
    from vecloom.operators.index import Index

    if keys is None:
        keys = index.trails().select("id", F.col("trail").alias("key"))
    perm = order_by_keys(keys, index.layer_counts()) if index.shards == 1 else order_within_shards(index, keys)
    return Index(permuted(index.elements, perm), reordered_graph(index.graph, perm), index.shards, index.kind, index.config), perm
