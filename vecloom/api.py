"""Objects in the manner of an index library, over the DataFrame operators.

    index = VectorIndex.open(spark, "hdfs:///index")
    index.search([0.1, 0.2, ...], max_search=200, num_elements=10)

One call answers one query with one job: for many queries use ``Index.search`` with a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions import vector as V
from vecloom.operators import embeddings as E
from vecloom.operators import reorder
from vecloom.operators.index import Index, IndexBuilder
from vecloom.operators.layered import BuildConfig
from vecloom.schemas import element_type
from vecloom.sources import files

DEFAULT_MAX_SEARCH, DEFAULT_NUM_ELEMENTS = 200, 10


def _as_element(kind: str, vec: Sequence[float]) -> list:
    x = np.asarray(vec, "f4")
    if kind == "angular_int":
        top = np.abs(x).max() if len(x) else np.float32(127)
        return (np.trunc(x * np.float32(127) / top) if top > 0 else np.zeros_like(x)).astype(int).tolist()
    n = float(np.sqrt((x.astype("f8") ** 2).sum()))
    return (x / np.float32(n)).tolist() if n > 0 else x.tolist()


def compute_distance(kind: str, a: Sequence[float], b: Sequence[float]) -> float:
    """Distance of two vectors, normalized or quantized first."""
    kind = element_type(kind)
    if len(a) != len(b):
        raise ValueError("vectors of different lengths")
    x, y = (np.asarray(_as_element(kind, v), "f8") for v in (a, b))
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return float(max(0.0, 1 - (x @ y / n if n > 0 else 0.0)))


class Embeddings:
    """A dictionary of words and their vectors."""

    def __init__(self, spark: SparkSession, dictionary: DataFrame | None = None):
        self.spark = spark
        self.dictionary = dictionary if dictionary is not None else spark.createDataFrame([], "word_id int, word string, vec array<float>")

    @staticmethod
    def open(spark: SparkSession, embeddings_path: str, words_path: str) -> Embeddings:
        """From parquet of ``(word_id, vec)`` and a word file."""
        vecs = spark.read.parquet(embeddings_path).select("word_id", "vec")
        named = files.words(spark, words_path)
        return Embeddings(spark, named.join(vecs.withColumnRenamed("word_id", "of"), F.col("word_id") == F.col("of"), "left").select("word_id", "word", "vec"))

    def __len__(self) -> int:
        return self.dictionary.count()

    @property
    def dim(self) -> int:
        return self.dictionary.agg(F.max(F.size("vec"))).first()[0] or 0

    def _terms(self, what: int | Sequence[int] | str) -> DataFrame:
        if isinstance(what, str):
            one = self.spark.createDataFrame([(0, what)], "id long, text string")
            return E.term_ids(one, "id", T.words(F.col("text")), E.word_dictionary(self.dictionary))
        return self.spark.createDataFrame([(0, [int(what)] if isinstance(what, int) else [int(i) for i in what])], "id long, term_ids array<int>")

    def get_embedding(self, what: int | Sequence[int] | str) -> list[float]:
        """The embedding of an id, or the sum of those of ids or of a text's known words."""
        return list(E.sum_embeddings(self._terms(what), self.dictionary, self.dim).first()["vec"])

    def dist(self, a: int | Sequence[int] | str, b: int | Sequence[int] | str) -> float:
        return compute_distance("angular", self.get_embedding(a), self.get_embedding(b))

    def dists(self, a: int | Sequence[int] | str, others: Sequence) -> list[float]:
        """The distances of all of ``others`` from ``a``, in one job."""
        numbered = self.spark.createDataFrame([], "id long, term_ids array<int>")
        texts = [(i, o) for i, o in enumerate([a, *others]) if isinstance(o, str)]
        lists = [(i, [int(o)] if isinstance(o, int) else [int(t) for t in o]) for i, o in enumerate([a, *others]) if not isinstance(o, str)]
        if texts:
            numbered = numbered.unionByName(E.term_ids(self.spark.createDataFrame(texts, "id long, text string"), "id", T.words(F.col("text")), E.word_dictionary(self.dictionary)))
        if lists:
            numbered = numbered.unionByName(self.spark.createDataFrame(lists, "id long, term_ids array<int>"))
        vecs = {r["id"]: list(r["vec"]) for r in E.sum_embeddings(numbered, self.dictionary, self.dim).collect()}
        return [compute_distance("angular", vecs[0], vecs[i + 1]) for i in range(len(others))]

    def append(self, vec: Sequence[float], word: str) -> bool:
        """Adds a word; False, and nothing is added, if it is known."""
        more = self.spark.createDataFrame([(word, [float(v) for v in vec])], "word string, vec array<float>")
        grown, flags = E.appended_words(self.dictionary, more)
        if not flags.first()["added"]:
            return False
        self.dictionary = grown
        return True

    def save(self, path: str) -> None:
        """Embeddings and words below one folder."""
        self.save_embeddings(f"{path}/embeddings")
        self.save_words(f"{path}/words")

    def save_embeddings(self, path: str) -> None:
        self.dictionary.select("word_id", "vec").write.mode("overwrite").parquet(path)

    def save_words(self, path: str) -> None:
        files.write_words(self.dictionary, path)


class VectorIndex:
    """A stored index that answers single queries."""

    def __init__(self, index: Index, embeddings: Embeddings | None = None, terms: DataFrame | None = None):
        self.index, self.embeddings, self.terms = index, embeddings, terms
        if index.kind == "embeddings" and (embeddings is None or terms is None):
            raise ValueError("an index of embeddings needs the dictionary and the term lists")

    @staticmethod
    def open(spark: SparkSession, path: str, embeddings: Embeddings | None = None, terms: DataFrame | None = None) -> VectorIndex:
        return VectorIndex(Index.load(spark, path), embeddings, terms)

    def __len__(self) -> int:
        return len(self.index)

    def search(self, element: Sequence[float] | str, max_search: int = DEFAULT_MAX_SEARCH, num_elements: int = DEFAULT_NUM_ELEMENTS) -> list[tuple]:
        """``(id, distance)``, or ``(text, distance)`` for an index of embeddings, nearest first. A text can be searched there."""
        spark = self.index.elements.sparkSession
        if isinstance(element, str):
            if self.embeddings is None:
                raise ValueError("a text can only be searched in an index of embeddings")
            vec = self.embeddings.get_embedding(element)
        else:
            vec = _as_element(self.index.kind, element)
        queries = spark.createDataFrame([(0, [float(v) for v in vec])], "query_id long, vec array<double>")
        found = [(r["id"], r["dist"]) for r in self.index.search(queries, max_search, num_elements).orderBy("rank").collect()]
        if self.index.kind != "embeddings":
            return found
        return [(self.get_internal_element(i), d) for i, d in found]

    def get_element(self, idx: int) -> list[float] | None:
        return self.index.get_element(idx)

    def get_internal_element(self, idx: int):
        """The element, or its words for an index of embeddings."""
        if self.index.kind != "embeddings":
            return self.get_element(idx)
        row = E.element_words(self.terms.where(F.col("id") == idx), self.embeddings.dictionary).first()
        return row and row["text"]

    def get_terms(self, idx: int) -> list[int] | None:
        """The term ids of an element of an index of embeddings; None if there is no such element."""
        if self.terms is None:
            raise ValueError("only an index of embeddings has terms")
        row = self.terms.where(F.col("id") == idx).select("term_ids").first()
        return row and list(row[0] or [])

    def get_neighbors(self, idx: int, layer: int | None = None) -> list[int]:
        return self.index.get_neighbors(idx, layer)

    def num_layers(self) -> int:
        return self.index.num_layers()

    def layer_len(self, layer: int) -> int:
        return self.index.layer_len(layer)

    def reorder(self) -> list[int]:
        """Renumbers the elements (by trail; for embeddings by their terms' norms); the old id of each new one, as a list here (``reordered`` keeps it distributed)."""
        return [r["old_id"] for r in self.reordered().orderBy("new_id").toLocalIterator()]

    def reordered(self) -> DataFrame:
        """As ``reorder``; the permutation ``(new_id, old_id)``."""
        keys = None
        if self.index.kind == "embeddings":
            norms = self.embeddings.dictionary.select("word_id", V.norm(F.col("vec")).alias("norm"))
            keys = reorder.norm_keys(self.terms, norms)
        self.index, perm = reorder.reordered_index(self.index, keys)
        if self.terms is not None:
            self.terms = reorder.permuted(self.terms, perm)
        return perm

    def save_index(self, path: str) -> None:
        self.index.save(path)

    def save_elements(self, path: str) -> None:
        (self.terms if self.terms is not None else self.index.elements).write.mode("overwrite").parquet(path)


class VectorIndexBuilder:
    """Collects elements one by one or as DataFrames, and builds."""

    def __init__(self, spark: SparkSession, kind: str, elements: DataFrame | None = None, embeddings: Embeddings | None = None, index: Index | None = None, **config):
        self.spark, self.kind, self.embeddings = spark, element_type(kind), embeddings
        if self.kind == "embeddings" and embeddings is None:
            raise ValueError("elements of embeddings need the dictionary")
        if index is not None and elements is None and self.kind != "embeddings":
            elements = index.elements
        self.config = BuildConfig(**config)
        self.index, self.pending = index, []
        self.elements = elements  # (id, vec), or (id, term_ids) for embeddings
        self.count = elements.count() if elements is not None else 0

    def append(self, element: Sequence[float] | str) -> None:
        """A vector (normalized or quantized), or a text for embeddings."""
        self.pending.append(element)

    def num_elements(self) -> int:
        return self.count + len(self.pending)

    def __len__(self) -> int:
        """Indexed elements."""
        return len(self.index) if self.index else 0

    def _flush(self) -> None:
        if not self.pending:
            return
        if self.kind == "embeddings":
            texts = self.spark.createDataFrame([(self.count + i, t) for i, t in enumerate(self.pending)], "id long, text string")
            more = E.term_ids(texts, "id", T.words(F.col("text")), E.word_dictionary(self.embeddings.dictionary))
        else:
            item = "tinyint" if self.kind == "angular_int" else "float"
            more = self.spark.createDataFrame([(self.count + i, _as_element(self.kind, v)) for i, v in enumerate(self.pending)], f"id long, vec array<{item}>")
        self.elements = more if self.elements is None else self.elements.unionByName(more)
        self.count, self.pending = self.count + len(self.pending), []

    def build(self, num_elements: int | None = None) -> VectorIndex:
        self._flush()
        vecs = self.elements
        if vecs is None:
            vecs = self.spark.createDataFrame([], "id long, vec array<float>")
        elif self.kind == "embeddings":
            sums = E.sum_embeddings(vecs, self.embeddings.dictionary, self.embeddings.dim)
            vecs = sums.select("id", V.normalize(F.col("vec")).cast("array<float>").alias("vec"))
        builder = IndexBuilder(vecs, self.config, self.kind, shards=None if self.index is None else self.index.shards, graph=self.index.graph if self.index else None)
        self.index = builder.build_partial(num_elements)
        return VectorIndex(self.index, self.embeddings, self.elements if self.kind == "embeddings" else None)


def parse_elements_and_save(spark: SparkSession, elements_path: str, words_path: str, output: str, shards: int = 1) -> int:
    """Element files to term ids as parquet, in shards; the number of elements."""
    lines = files.element_lines(spark, elements_path)
    parsed = E.parse_elements(lines, "id", "value", E.word_dictionary(files.words(spark, words_path)))
    return files.write_shards(parsed, output, shards)


def compute_embeddings_and_save(spark: SparkSession, terms_path: str, embeddings_path: str, output: str) -> None:
    """Term ids to quantized sums of embeddings, as parquet."""
    dictionary = spark.read.parquet(embeddings_path)
    dim = dictionary.agg(F.max(F.size("vec"))).first()[0] or 0
    E.quantized_sums(spark.read.parquet(terms_path), dictionary, dim).write.mode("overwrite").parquet(output)
