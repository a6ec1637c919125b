"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import clusters, frequency, leakage, lookalike, neighbours, packing, reformatted, subset, truncation, vectors
from vecloom.session import checkpointed, table


VECTOR_TABLES = {"vectors_f32": "id", "dict": "word_id"}


def _union(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for tab, df in parts.items():
        df = df.select(F.lit(tab).alias("tab"), "*")
        out = df if out is None else out.unionByName(df)
    return out


# --- 1: a varied subset -----------------------------------------------------------------


def p1_subset(spark: SparkSession, sf: str) -> DataFrame:
    return _union({tab: subset.varied_subset(table(spark, sf, tab), key, "vec") for tab, key in VECTOR_TABLES.items()})


def p1_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the subsets: their sizes, and no id twice."""
    chosen = p1_subset(spark, sf)
    return chosen.groupBy("tab").agg(F.count("*").alias("ids"), F.count_distinct("id").alias("different"))


# --- 2: most similar vectors ------------------------------------------------------------


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _union({tab: neighbours.near_pairs(table(spark, sf, tab), key, "vec", within=0.003) for tab, key in VECTOR_TABLES.items()})


def p2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _union({tab: neighbours.nearest(table(spark, sf, tab), key, "vec", complete=False) for tab, key in VECTOR_TABLES.items()})


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the lists: ten for every id, ranks in order of distance, no id its own neighbour, none twice in a list."""
    lists = p2_nearest(spark, sf).groupBy("tab", "id").agg(F.sort_array(F.collect_list(F.struct("rank", "dist", "near_id"))).alias("near"))  # ten rows a list
    dists, ids = F.transform("near", lambda e: e["dist"]), F.transform("near", lambda e: e["near_id"])
    wrong = (F.array_sort(dists) != dists) | F.array_contains(ids, F.col("id")) | (F.size(F.array_distinct(ids)) != F.size(ids))
    return lists.groupBy("tab").agg(F.count("*").alias("ids"), F.sum(F.size("near")).alias("neighbours"), F.sum(wrong.cast("long")).alias("wrong"))


# --- 3: frequency of every term ---------------------------------------------------------


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = frequency.word_frequencies(table(spark, sf, "terms"), table(spark, sf, "word_list"))
    return found.where("known and mark is not null").select("word_id", "mark")


def p3_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.word_frequencies(table(spark, sf, "terms"), table(spark, sf, "word_list")).drop("known")


# --- 4: look-alike words ----------------------------------------------------------------


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf, "word_list"), "word_id", "word").select(F.col("key_a").alias("word_id_a"), F.col("key_b").alias("word_id_b"))


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    forms = lookalike.with_canonical(table(spark, sf, "word_list"), "word_id", "word")
    return forms.select(F.col("key").alias("word_id"), F.col("value").alias("word"), "canonical")


# --- 5: duplicates in other formats -----------------------------------------------------


def _p5_keyed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "terms": reformatted.keyed_records(table(spark, sf, "terms"), "id", reformatted.list_key(F.col("term_ids"))),
        "element_lines": reformatted.keyed_records(table(spark, sf, "element_lines"), "line_id", reformatted.line_key(F.col("value"))),
        "word_list": reformatted.keyed_records(table(spark, sf, "word_list"), "word_id", reformatted.text_key(F.col("word"))),
    }


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _union({tab: reformatted.copies_of(df) for tab, df in _p5_keyed(spark, sf).items()})


def p5_kept(spark: SparkSession, sf: str) -> DataFrame:
    return _union({tab: reformatted.kept_with_counts(df) for tab, df in _p5_keyed(spark, sf).items()})


# --- 6: groups of similar vectors -------------------------------------------------------


def _p6_groups(spark: SparkSession, sf: str, ranked: bool = True) -> dict[str, DataFrame]:
    return {tab: clusters.similarity_groups(table(spark, sf, tab), key, "vec", ranked=ranked) for tab, key in VECTOR_TABLES.items()}


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _union({tab: df.where("id <> lead_id").select("lead_id", "id") for tab, df in _p6_groups(spark, sf, ranked=False).items()})


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _union({tab: clusters.described_groups(df) for tab, df in _p6_groups(spark, sf).items()})


def p6_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _union({tab: clusters.described_groups(df).select("lead_id", "size") for tab, df in _p6_groups(spark, sf, ranked=False).items()})


def p6_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Records of terms, vectorised by hashed weighted features, in k-means clusters with size and most typical members."""
    features = checkpointed(vectors.hashed_features(table(spark, sf, "terms"), "id", "term_ids", dim=64))
    found = clusters.clustered(features, "id", "vec").withColumnRenamed("cluster", "lead_id")
    return clusters.described_groups(found).withColumnRenamed("lead_id", "cluster")


# --- 7: containers of tokens ------------------------------------------------------------


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_certificates(spark: SparkSession, sf: str) -> DataFrame:
    return packing.certificates(packing.packed(packing.token_counts(table(spark, sf, "documents"), "doc_id", "text")))


def p7_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the containers: every document once and whole, pieces only of what is larger than a container, none overfull, places without gaps."""
    rows = p7_containers(spark, sf)
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("upto"))
    kept = rows.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.max("position").alias("last"))
    of_docs = docs.agg(F.count("*").alias("docs"), F.count_if((F.col("tokens") != F.col("upto")) | ((F.col("pieces") > 1) & (F.col("tokens") <= 1024))).alias("torn"))
    return of_docs.crossJoin(kept.agg(F.count_if(F.col("tokens") > 1024).alias("overfull"), F.count_if(F.col("last") + 1 != F.col("n")).alias("gaps")))  # one row each


# --- 8: leaked evaluation passages ------------------------------------------------------


def _p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p8_leaks(spark, sf).select("doc_id", F.col("item_id").cast("int").alias("item_id"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks_by_item(_p8_leaks(spark, sf), table(spark, sf, "eval_items"), "item_id")


def p8_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """The leaks that need no tolerance: 20 words of the item stand in the document as they are."""
    plain = lambda c: F.array_join(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]+", ""), r"\s+"), lambda w: w != ""), " ")
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("d"), F.concat(F.lit(" "), plain(F.col("text")), F.lit(" ")).alias("doc"))
    words = F.split(plain(F.col("passage")), " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 19, F.lit(1))), lambda i: F.concat(F.lit(" "), F.array_join(F.slice(words, i, 20), " "), F.lit(" ")))
    items = table(spark, sf, "eval_items").where("passage is not null").select(F.col("item_id").alias("i"), runs.alias("runs"))
    leaks = p8_found(spark, sf).join(items, F.col("item_id") == F.col("i")).join(docs, F.col("doc_id") == F.col("d"))
    return leaks.where(F.exists("runs", lambda r: F.contains("doc", r))).select("doc_id", "item_id").distinct()


def p8_paraphrases(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.paraphrased_passages(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage")
    return found.select("doc_id", "item_id", F.round(F.col("common").cast("double"), 3).alias("common"), F.round(F.col("answer").cast("double"), 3).alias("answer"))


# --- 9: truncated texts -----------------------------------------------------------------


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    flags = truncation.truncation_flags(table(spark, sf, "documents"), "doc_id", "source", "text")
    return flags.where("truncated").select(F.col("id").alias("doc_id"))


def p9_sources(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_by_source(table(spark, sf, "documents"), "doc_id", "source", "text")


def p9_signals(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_signals(table(spark, sf, "documents"), "doc_id", "source", "text")


QUERIES = [p1_subset, p1_sizes, p2_found, p2_nearest, p2_counts, p3_found, p3_frequencies, p4_found, p4_forms, p5_found, p5_kept, p6_found, p6_groups, p6_sizes, p6_clusters, p7_containers, p7_certificates, p7_coverage, p8_found, p8_items, p8_verbatim, p8_paraphrases, p9_found, p9_sources, p9_signals]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
