"""Documents packed into containers of a fixed number of tokens.

Tokens are counted with a vocabulary file of a public tokenizer (its path is a parameter). The
pattern that splits a text before any merge is applied to the whole text, and the length of
each split piece is remembered, up to a bound: the count is exact, and a piece that occurs
again costs a look-up.

A text above the capacity fills whole containers of its own; its remainder, and every other
text whole, is an item. Items are spread by a hash of their id over partitions of about
``PARTITION_ITEMS``, and each is packed best-fit decreasing. Dual feasible functions bound from
below how many containers a partition's items need at least: where the packing has just as
many, it is certified to be the best. Partitions with a gap then exchange documents: some of
them are thrown together, the items of all their containers with room left are packed again,
and the outcome is kept if it needs fewer containers. This is repeated a few times.

Null ids are left out; null and empty texts are items of no tokens (they get a place in a
container that is there anyway). Rows that share an id count once (the longest text).
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import checkpointed, spread

PARTITION_ITEMS = 8192
#: Partitions thrown together in an exchange.
EXCHANGE = 4
#: Fixed value: the splitting pattern that belongs to the vocabulary files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_COUNTERS: dict = {}


def default_vocabulary() -> str:
    """The path of the byte-level vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TokenCounter:
    """Counts the tokens of texts; remembers the length of split pieces, up to a bound."""

    def __init__(self, path: str, most: int = 500_000):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(SPLIT).findall
        self.lengths: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str) -> int:
        pieces = self.split(text)
        lengths = self.lengths
        try:
            return sum([lengths[p] for p in pieces])
        except KeyError:
            if len(lengths) > self.most:
                lengths.clear()
            for p in pieces:
                if p not in lengths:
                    lengths[p] = len(self.encoding.encode_ordinary(p))
            return sum([lengths[p] for p in pieces])


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """``(id, tokens)``, one row per id."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path)
        count = _COUNTERS[path]
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["id", "tokens"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return spread(texts).mapInArrow(run, "id long, tokens long").groupBy("id").agg(F.max("tokens").alias("tokens"))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item, packed best-fit decreasing (ties in the given order), and the number of bins."""
    bins = np.zeros(len(sizes), "i8")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: a bin with r tokens of room
    n = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[k])
        fitting = there >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                there &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[k] = b
        left = room - s
        free[left].append(b)
        there |= 1 << left
    return bins, n


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The greatest lower bound on the number of bins by a family of dual feasible functions.

    The identity; for each threshold, items larger than capacity minus threshold count as a
    whole bin and items smaller than the threshold as nothing; and, for a few k, the rounding
    of (k+1) x size / capacity.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype("i8")
    value = np.arange(capacity + 1)
    best = math.ceil((count * value).sum() / capacity)
    many, mass = np.cumsum(count), np.cumsum(count * value)
    for t in range(1, capacity // 2 + 1):
        large = many[capacity] - many[capacity - t]
        middle = mass[capacity - t] - mass[t - 1]
        best = max(best, large + math.ceil(middle / capacity))
    for k in range(1, 21):
        scaled = (k + 1) * value
        f = np.where(scaled % capacity == 0, value * k, (scaled // capacity) * capacity)  # in units of 1 / (k capacity)
        best = max(best, math.ceil((count * f).sum() / (k * capacity)))
    if not best:
        best = 1  # items of no size need a bin too
    return int(best)


_PLACED = "id long, piece long, size int, part long, bin long, bins long, bound long"


def _packed(capacity: int):
    def run(key, group):
        group = group.sort_values(["id", "piece"], kind="stable", ignore_index=True)
        sizes = group["size"].to_numpy()
        bins, n = best_fit(sizes, capacity)
        return group[["id", "piece", "size"]].assign(part=int(key[0]), bin=bins, bins=n, bound=lower_bound(sizes, capacity))

    return run


def _repacked(capacity: int):
    def run(key, group):
        group = group.sort_values(["id", "piece"], kind="stable", ignore_index=True)
        sizes = group["size"].to_numpy()
        old = group.groupby(["old_part", "bin"], sort=True).ngroup().to_numpy()
        n_old = int(old.max()) + 1
        fill = np.bincount(old, weights=sizes, minlength=n_old)
        bound = lower_bound(sizes, capacity)
        best, n_best = old, n_old
        for slack in (1, 4, 16, 64):  # the items of containers with so much room are packed again
            open_bin = fill <= capacity - slack
            moved = open_bin[old]
            bins, n = best_fit(sizes[moved], capacity)
            if n + (~open_bin).sum() < n_best:
                kept = np.cumsum(~open_bin) - 1
                best = np.where(moved, 0, kept[old])
                best[moved] = bins + int((~open_bin).sum())
                n_best = n + int((~open_bin).sum())
            if n_best <= bound:
                break
        return group[["id", "piece", "size"]].assign(part=int(key[0]), bin=best, bins=n_best, bound=bound)

    return run


def packed(counts: DataFrame, capacity: int = 1024, exchanges: int = 3) -> DataFrame:
    """``(id, piece, first_token, tokens, part, bin, bins, bound)`` for ``(id, tokens)``.

    ``bins`` and ``bound`` are the containers of the item's partition and their lower bound;
    a piece that fills a container of its own is in partition -1.
    """
    counts = checkpointed(counts)
    c = F.lit(capacity)
    whole = F.floor(F.col("tokens") / c).cast("long")
    rest = (F.col("tokens") - whole * c).cast("int")
    full = counts.where(whole > 0).select("id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece")).select(
        "id", "piece", (F.col("piece") * c).cast("long").alias("first_token"), c.cast("int").alias("tokens"), F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("bins"), F.lit(0).cast("long").alias("bound")
    )
    items = counts.where((rest > 0) | (whole == 0)).select("id", whole.alias("piece"), rest.alias("size"))
    parts = max(1, math.ceil(items.count() / PARTITION_ITEMS))
    place = items.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    placed = checkpointed(place.groupBy("part").applyInPandas(_packed(capacity), _PLACED))
    serial = parts
    for turn in range(exchanges):
        gaps = placed.where("bins > bound").select("part").distinct().count()
        if gaps < 2:
            break
        groups = max(1, math.ceil(gaps / EXCHANGE))
        again = placed.where("bins > bound").select("id", "piece", "size", F.col("part").alias("old_part"), "bin", (F.lit(serial) + F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(groups))).alias("part"))
        placed = checkpointed(placed.where("bins <= bound").unionByName(again.groupBy("part").applyInPandas(_repacked(capacity), _PLACED)))
        serial += groups
    rests = placed.select("id", "piece", (F.col("piece") * c).cast("long").alias("first_token"), F.col("size").alias("tokens"), "part", "bin", "bins", "bound")
    return full.unionByName(rests)


def containers(placed: DataFrame) -> DataFrame:
    """``(container, position, id, piece, first_token, tokens)``: positions count from 0 in each container, larger items first."""
    from pyspark.sql import Window

    name = F.when(F.col("part") < 0, F.concat(F.lit("whole-"), "id", F.lit("-"), "piece")).otherwise(F.concat("part", F.lit("-"), "bin"))
    order = Window.partitionBy("container").orderBy(F.desc("tokens"), "id", "piece")
    return placed.withColumn("container", name).withColumn("position", (F.row_number().over(order) - 1).cast("int")).select("container", "position", "id", "piece", "first_token", "tokens")


def certificates(placed: DataFrame) -> DataFrame:
    """``(part, items, tokens, containers, bound, gap)`` for each partition of items."""
    return (
        placed.where("part >= 0")
        .groupBy("part")
        .agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.max("bins").alias("containers"), F.max("bound").alias("bound"))
        .withColumn("gap", F.col("containers") - F.col("bound"))
    )


def pack_documents(df: DataFrame, id_col: str, text_col: str, capacity: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """``(container, position, id, piece, first_token, tokens)`` of all documents."""
    return containers(packed(token_counts(df, id_col, text_col, vocabulary), capacity))
