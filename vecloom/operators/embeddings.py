"""Elements that are sums of embeddings: dictionary, text to term ids, term ids to vectors.

Joins with the dictionary are left to the optimizer, which broadcasts it only below its size
limit; sums send it to the tasks if it is no larger than ``DICTIONARY_BYTES``. A hot word does no harm: a join with a dictionary has one row per word on that side,
and what is grouped is one element at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from vecloom.functions import text as T
from vecloom.functions import vector as V
from vecloom.session import spread


def word_dictionary(words: DataFrame, id_col: str = "word_id", word_col: str = "word") -> DataFrame:
    """``(word, word_id)``: of several ids of one word the last."""
    rows = words.where(F.col(word_col).isNotNull() & F.col(id_col).isNotNull())
    return rows.groupBy(F.col(word_col).alias("word")).agg(F.max(id_col).alias("word_id"))


def frequent_words(texts: DataFrame, text_col: str, size: int) -> DataFrame:
    """``(word_id, word, n)``: the most frequent blank-separated tokens, numbered from 0 by (count desc, token)."""
    tokens = texts.select(F.explode(F.split(F.col(text_col), r"\s+")).alias("word")).where("word <> ''")
    top = tokens.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    numbered = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "word"))).alias("a"))  # at most ``size`` rows
    return numbered.select(F.posexplode("a").alias("word_id", "e")).select("word_id", F.col("e.word").alias("word"), (-F.col("e.neg")).alias("n"))


def term_ids(elements: DataFrame, id_col: str, words: Column, dictionary: DataFrame) -> DataFrame:
    """``(id, term_ids)``: the ids of the known words in their order, repeated words kept, unknown ones dropped; no known word gives an empty list."""
    rows = elements.select(F.col(id_col).alias("id"), words.alias("words"))
    known = dictionary.select(F.col("word").alias("known_word"), F.col("word_id"))
    placed = rows.select("id", F.posexplode_outer("words").alias("pos", "word")).join(known, F.col("word") == F.col("known_word"), "left")
    hits = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("word_id").isNotNull(), F.struct("pos", "word_id")))).alias("hits"))
    return hits.select("id", F.transform("hits", lambda h: h["word_id"]).alias("term_ids"))


def parse_elements(lines: DataFrame, id_col: str, line_col: str, dictionary: DataFrame) -> DataFrame:
    """``(id, term_ids)`` of element lines: the text after the last colon of each JSON string. Lines that are none give an empty list."""
    return term_ids(lines, id_col, T.words(T.after_last_colon(T.json_text(F.col(line_col)))), dictionary)


#: Bytes up to which a dictionary, in its own precision, is sent to all tasks.
DICTIONARY_BYTES = 128 << 20


def sum_embeddings(terms: DataFrame, dictionary: DataFrame, dim: int, id_col: str = "id", terms_col: str = "term_ids") -> DataFrame:
    """``(id, vec)``: the sum of the listed embeddings, each as often as it is listed, in double precision.

    An empty list gives zeros; ids without an embedding, and embeddings that are null, add nothing; of several embeddings of one id the greatest counts.
    A dictionary of at most ``DICTIONARY_BYTES`` is sent to the tasks, which gather and add without a shuffle; a larger one is joined. A vector that is not of length ``dim`` raises an error.
    """
    return summing(dictionary, dim)(terms, id_col, terms_col)


def summing(dictionary: DataFrame, dim: int) -> Callable[..., DataFrame]:
    """``sum_embeddings`` of one dictionary, which is sent once: a function of terms and the names of their columns."""
    vecs = dictionary.where("vec is not null").groupBy("word_id").agg(F.max("vec").alias("vec"))
    single = dictionary.schema["vec"].dataType == T_.ArrayType(T_.FloatType(), dictionary.schema["vec"].dataType.containsNull)
    most = DICTIONARY_BYTES // (8 + (4 if single else 8) * dim)
    rows = vecs.select(F.col("word_id").cast("long").alias("word_id"), F.col("vec").cast("array<float>" if single else "array<double>").alias("vec"))
    some = (rows if dictionary.count() <= most else rows.limit(most + 1)).toArrow()  # a limit moves all rows to one task
    if some.num_rows <= most:
        return _gathering(dictionary.sparkSession, some, dim, "f4" if single else "f8")
    return lambda terms, id_col="id", terms_col="term_ids": joined_sums(terms, vecs, dim, id_col, terms_col)


def _gathering(spark: SparkSession, table: pa.Table, dim: int, kind: str) -> Callable[..., DataFrame]:
    words = table.column("word_id").to_numpy()
    order = np.argsort(words)
    held, at = np.zeros((len(words) + 1, dim), kind), 0
    for chunk in table.column("vec").chunks:
        flat = chunk.flatten().to_numpy(zero_copy_only=False)
        if len(flat) != len(chunk) * dim:
            raise ValueError("vectors of different lengths")
        held[at : at + len(chunk)] = flat.reshape(-1, dim)
        at += len(chunk)
    sent = spark.sparkContext.broadcast((words[order], np.append(order, len(words)), held))
    return lambda terms, id_col="id", terms_col="term_ids": _gathered_sums(terms, sent, dim, id_col, terms_col)


def _gathered_sums(terms: DataFrame, sent: Broadcast, dim: int, id_col: str, terms_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held_at, vecs = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = part.column(1)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                listed = pc.fill_null(lists.flatten(), -1).to_numpy()
                place = np.minimum(np.searchsorted(known, listed), max(0, len(known) - 1))
                place = np.where(known[place] == listed, place, len(known)) if len(known) else np.zeros(len(listed), "i8")
                sums = np.zeros((part.num_rows, dim))
                own = np.repeat(np.arange(part.num_rows), lengths)
                for a in range(0, len(own), 65536):  # a very long list is added up in pieces
                    o, p = own[a : a + 65536], place[a : a + 65536]
                    heads = np.flatnonzero(np.diff(o, prepend=-1))
                    sums[o[heads]] += np.add.reduceat(vecs[held_at[p]].astype("f8", copy=False), heads, axis=0)
                offsets = np.arange(part.num_rows + 1, dtype="i4") * dim
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))], names=["id", "vec"])

    rows = terms.select(F.col(id_col).alias("id"), F.col(terms_col).cast("array<long>").alias("terms"))
    kind = T_.StructType([T_.StructField("id", rows.schema["id"].dataType), T_.StructField("vec", T_.ArrayType(T_.DoubleType()))])
    return spread(rows).mapInArrow(run, kind)


def joined_sums(terms: DataFrame, vecs: DataFrame, dim: int, id_col: str = "id", terms_col: str = "term_ids") -> DataFrame:
    """As ``sum_embeddings``, by a join with the dictionary ``(word_id, vec)``, however large."""
    listed = terms.select(F.col(id_col).alias("id"), F.explode_outer(terms_col).alias("term"))
    counts = listed.groupBy("id", "term").agg(F.count("*").alias("n"))
    joined = counts.join(vecs, F.col("term") == F.col("word_id"), "left").select("id", "n", "vec")
    zero = F.array_repeat(F.lit(0.0), dim)
    add = lambda a, e: F.when(e["vec"].isNull(), a).otherwise(F.zip_with(a, e["vec"], lambda p, q: p + q.cast("double") * e["n"]))
    # a list is one element's; the order of addition is fixed by sorting
    grouped = joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "vec"))).alias("parts"))
    return grouped.select("id", F.aggregate("parts", zero, add).alias("vec"))


def element_words(terms: DataFrame, dictionary: DataFrame, id_col: str = "id", terms_col: str = "term_ids") -> DataFrame:
    """``(id, text)``: the listed words joined by blanks; ids without a word are left out."""
    placed = terms.select(F.col(id_col).alias("id"), F.posexplode_outer(terms_col).alias("pos", "term"))
    named = placed.join(dictionary.select("word_id", "word").dropDuplicates(["word_id"]), F.col("term") == F.col("word_id"), "left")
    hits = named.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))).alias("hits"))
    return hits.select("id", F.array_join(F.transform("hits", lambda h: h["word"]), " ").alias("text"))


def text_vectors(texts: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, dim: int) -> DataFrame:
    """``(id, vec)`` of search texts: their words' embeddings, summed and normalized (a text without a known word: zeros)."""
    terms = term_ids(texts, id_col, T.words(F.col(text_col)), word_dictionary(dictionary))
    return sum_embeddings(terms, dictionary, dim).select("id", V.normalize(F.col("vec")).alias("vec"))


def appended_words(dictionary: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary with the new words of ``more (word, vec)``, numbered on by word; and ``(word, added)`` for each word offered."""
    offered = more.groupBy("word").agg(F.max("vec").alias("vec"))
    known = dictionary.select(F.col("word").alias("w")).distinct()
    fresh = offered.join(known, F.col("word") == F.col("w"), "left_anti")
    start = dictionary.agg(F.coalesce(F.max("word_id") + 1, F.lit(0)).alias("s")).first()["s"]
    from vecloom.operators.ids import numbered

    added = numbered(fresh, "word_id", start, by="word").withColumn("word_id", F.col("word_id").cast("int"))
    flags = offered.join(known, F.col("word") == F.col("w"), "left").select("word", F.col("w").isNull().alias("added"))
    return dictionary.select("word_id", "word", "vec").unionByName(added.select("word_id", "word", "vec")), flags


def quantized_sums(terms: DataFrame, dictionary: DataFrame, dim: int) -> DataFrame:
    """``(id, vec ARRAY<TINYINT>)``: summed, normalized and quantized, to be stored."""
    return sum_embeddings(terms, dictionary, dim).select("id", V.quantize(V.normalize(F.col("vec"))).alias("vec"))
