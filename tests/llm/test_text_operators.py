"""Frequencies, look-alikes, reformatted duplicates, leakage, truncation: edge cases, brute force, SQL."""

import json
import random
import re
import string

import pytest
from against_sql import compare
from pyspark.sql import functions as F

from vecloom.llm import frequency, leakage, lookalike, oracle, packing, queries, reformatted, truncation


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    compare(spark, small, queries.queries()[name], oracle.oracle_sql()[name])


# --- frequency


def test_frequencies(spark):
    terms = spark.createDataFrame(
        [(1, [5, 5, 6], "x"), (1, [5, 5, 6], "x"), (2, [5], None), (3, [], "y"), (4, None, "y"), (None, [5], "z"), (-70000, [5, None], "z"), (10**12, [7], "q")],
        "id long, term_ids array<int>, docs string",
    )
    words = spark.createDataFrame([(5, "five", 0), (5, "five", 1), (6, None, 0), (8, "unused", 0), (None, "none", 0)], "word_id int, word string, occurrences int")
    got = {r["word_id"]: (r["word"], r["docs"], r["occurrences"], r["mark"], r["known"]) for r in frequency.word_frequencies(terms, words).collect()}
    assert got == {5: ("five", 3, 4, "common", True), 6: (None, 1, 1, "rare", True), 7: (None, 1, 1, "rare", False)}
    empty = terms.where("id = 77")
    assert frequency.word_frequencies(empty, words).count() == 0
    assert frequency.record_count(empty, "id", "term_ids").first()["total"] == 0
    assert frequency.record_count(terms, "id", "term_ids").first()["total"] == 6


def test_dense_and_sparse_containers_and_union(spark):
    df = spark.range(40000).select("id", F.when(F.col("id") % 1000 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("t"))
    layout = frequency.term_bitmaps(df, "id", "t")
    kinds = {(r["term"], r["bitmap"] is not None) for r in layout.collect()}
    assert kinds == {(1, True), (2, False)}
    counts = {r["term"]: (r["docs"], r["occurrences"]) for r in frequency.frequencies(layout).collect()}
    assert counts == {1: (40000, 40000), 2: (40, 40)}
    a, b = (frequency.term_bitmaps(df.where(c), "id", "t") for c in ("id % 2 = 0", "id % 2 = 1"))
    assert {r["term"]: (r["docs"], r["occurrences"]) for r in frequency.frequencies(frequency.union_bitmaps(a, b)).collect()} == counts


# --- look-alikes


def test_lookalikes(spark):
    rows = [
        (1, "page"), (2, "раgе"), (3, "ｐａｇｅ"), (4, "pa​ge"), (5, "page"), (6, "Page"), (7, "page."), (8, "pagé"), (9, "pagé"),
        (10, "two words"), (11, "two words"), (12, "two　words "), (13, "two  words"), (14, None), (None, "page"), (15, ""), (16, " "), (17, "ﬂaﬆ"), (18, "flast"),
        (1, "page"), (19, "ộ"), (20, "ộ"), (21, "ộ"), (22, "x" * 100_000),
    ]
    df = spark.createDataFrame(rows, "word_id int, word string").withColumn("canonical", F.lit("clash")).withColumn("key", F.lit(1))
    pairs = {tuple(r) for r in lookalike.lookalike_pairs(df, "word_id", "word").collect()}
    same = [[1, 2, 3, 4, 5], [8, 9], [10, 11, 12], [15, 16], [17, 18], [19, 20, 21]]
    words = dict((i, w) for i, w in rows if i)
    want = {(a, b) for g in same for a in g for b in g if a < b and words[a] != words[b]}
    assert pairs == want
    groups = lookalike.lookalike_groups(df, "word_id", "word")
    assert {r["lead_key"] for r in groups.collect()} == {1, 8, 10, 15, 17, 19}
    forms = {r["key"]: r["canonical"] for r in lookalike.with_canonical(df, "word_id", "word").collect()}
    assert len({forms[i] for i in (1, 2, 3, 4, 5)}) == 1 and forms[6] == "Page"
    assert lookalike.lookalike_pairs(df.where("word_id > 99"), "word_id", "word").count() == 0


# --- reformatted duplicates


def _key(text):
    ws = [w.strip(string.punctuation) for w in re.split("[ \t\n\x0b\f\r]+", text.lower())]
    return " ".join(sorted(w for w in ws if w)) or None


def test_keys(spark):
    texts = ["A b", " b\ta!", "b -- (a)", "a b", "", " ", "...", None, "a-b", '"A" b.', "a b b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r["id"]: r["k"] for r in df.select("id", reformatted.text_key(F.col("t")).alias("k")).collect()}
    assert got == {i: None if t is None else _key(t) for i, t in enumerate(texts)}
    lines = ['"x: A b"', '"A b', '" p : q:b  a"', "5", '["a"]', '"a" "b"', '"caf\\u00e9 b"', '"bad \\q"', '"a\tb"', None, '"x:"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id long, t string")
    got = {r["id"]: r["k"] for r in df.select("id", reformatted.line_key(F.col("t")).alias("k")).collect()}

    def line(t):
        try:
            s = json.loads(t)
        except (TypeError, ValueError):
            return None
        return _key(s.rsplit(":", 1)[-1]) if isinstance(s, str) else None

    assert got == {i: line(t) for i, t in enumerate(lines)}


def test_copies_over_many_partitions(spark):
    # a third of the rows share one key: its run crosses partitions
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key"))
    df = df.unionByName(df.where("id % 50 = 0"))  # delivered twice
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {tuple(r) for r in reformatted.copies_of(df).collect()}
        n = reformatted.copies_of(df).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    groups = {}
    for i in range(3000):
        groups.setdefault("hot" if i % 3 == 0 else f"k{i % 700}", []).append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert got == want and n == len(want)
    counts = {r["kept_id"]: r["copies"] for r in reformatted.kept_with_counts(df).collect()}
    assert counts == {min(g): len(g) - 1 for g in groups.values()}


def test_copies_edge_cases(spark):
    df = spark.createDataFrame([(3, [1, 2], 0), (1, [2, 1], 0), (1, [2, 1], 0), (2, None, 0), (None, [1, 2], 0), (4, [], 0), (5, [2, 1, 1], 0), (6, [None], 0)], "id long, key array<int>, kept long")
    keyed = reformatted.keyed_records(df, "id", reformatted.list_key(F.col("key")))
    assert [tuple(r) for r in reformatted.copies_of(keyed).collect()] == [(1, 3)]
    assert reformatted.copies_of(keyed.where("id > 99")).count() == 0
    long = spark.createDataFrame([(1, "a " * 200_000), (2, "A " * 200_000)], "id long, t string")
    assert reformatted.copies_of(reformatted.keyed_records(long, "id", reformatted.text_key(F.col("t")))).collect()[0]["copy_id"] == 2


# --- leakage

PASSAGE = " ".join(f"{a} {b} walks over the {c} bridge while" for a, b, c in zip(["the", "seven", "old", "many", "loud"], ["heron", "miller", "sailor", "doctor", "piper"], ["stone", "iron", "wooden", "narrow", "ancient"]))
NOISE = "wheat at the market fetched nine shillings on monday and oats a little less than last week said the clerk of the council "


def test_leaks(spark):
    words = PASSAGE.split()
    cut = lambda a, b: " ".join(words[a:b])
    broken = cut(5, 30).replace("miller", "mil-\nler").replace("sailor", "sai\nlor").replace("walks", "WALKS,").replace("bridge", "bridqe")
    docs = [
        (1, NOISE + cut(3, 25) + " " + NOISE), (2, NOISE + cut(3, 21) + " " + NOISE), (3, NOISE + broken + "\n" + NOISE), (4, None), (5, ""), (6, " \n "), (None, PASSAGE),
        (7, PASSAGE), (7, PASSAGE), (8, NOISE * 400 + PASSAGE + " " + NOISE * 400), (9, NOISE * 3), (10, " ".join(reversed(words))),
    ]
    items = spark.createDataFrame([(1, PASSAGE, 0), (2, None, 0), (None, PASSAGE, 0), (3, "", 0)], "item_id int, passage string, doc_id int")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9))
    leaks = leakage.leaked_passages(df, "doc_id", "text", items, "item_id", "passage")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in leaks.collect()}
    assert got == {(1, 1): 22, (3, 1): 25, (7, 1): len(words), (8, 1): len(words)}
    assert {r["item_id"]: r["docs"] for r in leakage.leaks_by_item(leaks, items, "item_id").collect()} == {1: 4, 2: 0, 3: 0}
    assert leakage.leaked_passages(df.where("doc_id > 99"), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leakage.leaked_passages(df, "doc_id", "text", items.where("item_id > 99"), "item_id", "passage").count() == 0


def test_leaks_equal_brute_force(spark, small):
    got = {tuple(r) for r in queries.p8_found(spark, small).collect()}
    docs = {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if r["text"]}
    items = leakage._Items.of([(r["item_id"], r["passage"]) for r in spark.read.parquet(f"{small}/eval_items.parquet").collect()])
    same, want = leakage.Matcher(), set()
    for d, text in docs:
        tokens = leakage._doc_tokens(text, items.vocabulary)
        for i, words in zip(items.ids, items.words):
            starts = {}
            for k in range(len(words) - 1):
                starts.setdefault((words[k], words[k + 1]), []).append(k)
            if leakage.longest_run(words, *tokens, same, starts) >= 20:
                want.add((d, i))
    assert got == want


# --- packing


def test_packing(spark):
    long = "word " * 5000
    docs = [(i, NOISE * (1 + i % 9)) for i in range(300)] + [(1000, long), (1001, None), (1002, ""), (None, "x"), (5, NOISE)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("part", F.lit(1))
    counter = packing.TokenCounter(packing.default_vocabulary())
    tokens = {}
    for i, t in docs:
        if i is not None:
            tokens[i] = max(tokens.get(i, 0), len(counter.encoding.encode_ordinary(t or "")))
    rows = packing.pack_documents(df, "doc_id", "text").collect()
    assert {r["id"] for r in rows} == set(tokens)
    fill, places, pieces = {}, {}, {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        places.setdefault(r["container"], []).append(r["position"])
        pieces.setdefault(r["id"], []).append((r["first_token"], r["tokens"]))
    assert max(fill.values()) <= 1024 and all(sorted(p) == list(range(len(p))) for p in places.values())
    for i, ps in pieces.items():
        at = 0
        for first, n in sorted(ps):
            assert first == at
            at += n
        assert at == tokens[i] and (len(ps) == 1 or tokens[i] > 1024)
    waste = 1 - sum(tokens.values()) / (1024 * len(fill))
    assert waste < 0.05
    assert packing.pack_documents(df.where("doc_id > 9999"), "doc_id", "text").count() == 0


def test_bounds_and_exchange(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins, n = packing.best_fit(sizes, 100)
        assert np.bincount(bins, weights=sizes).max() <= 100 and packing.lower_bound(sizes, 100) <= n
    assert packing.lower_bound(np.array([51] * 10), 100) == 10
    assert packing.lower_bound(np.array([34, 34, 34] * 4), 100) == 6
    counts = spark.range(40_000).select("id", (F.pmod(F.hash("id"), F.lit(700)) + 1).cast("long").alias("tokens"))
    placed = packing.packed(counts)
    report = packing.certificates(placed).collect()
    assert all(0 <= r["gap"] for r in report) and sum(r["gap"] for r in report) <= 1 + len(report) // 2
    assert placed.select("id").distinct().count() == 40_000


# --- truncation


def test_truncation(spark):
    whole = "The mill was sold. The rent is small"
    texts = {
        1: whole + ".", 2: whole, 3: whole + "...", 4: whole + " […]", 5: whole + ".\n(To be continued.)", 6: whole + ".\n—H. Walker", 7: whole + ".\n* * *", 8: "LATEST NEWS", 9: whole + ".\nSHIPPING",
        10: None, 11: " \n", 12: "", 13: whole + ". He met Mr.", 14: whole + ' of "peace."', 15: whole + ". ", 16: "x" * 200_000, 17: whole + ".\nBox 4s. 2d.", 18: "Wheat fetched 29s.",
    }
    df = spark.createDataFrame([(i, t, "a") for i, t in texts.items()] + [(None, whole, "a"), (1, whole + ".", "a")], "doc_id long, text string, source string").withColumn("truncated", F.lit("clash")).withColumn("id", F.lit(0))
    flags = {r["id"]: r["truncated"] for r in truncation.truncation_flags(df, "doc_id", "source", "text").collect()}
    assert {i for i, f in flags.items() if f} == {2, 3, 4, 13, 16, 18} and len(flags) == 18
    assert truncation.truncation_by_source(df.where("doc_id > 99"), "doc_id", "source", "text").count() == 0


def test_spikes(spark):
    rows = [(i, "b" * (20 + i % 60) + ".", "free") for i in range(300)]
    rows += [(1000 + i, ("a" * (20 + i % 90) + ".")[:60] if i % 2 else "LONG HEADING " * 4 + "CUT HERE", "chars") for i in range(200)]
    rows += [(2000 + i, "é" * 30 if i % 2 else "a" * (i % 50) + ".", "bytes") for i in range(100)]
    rows += [(3000, "a.", None), (3001, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    limits = {r["source"]: (r["char_limit"], r["byte_limit"]) for r in truncation.length_spikes(truncation.end_features(df, "id", "source", "text")).collect()}
    assert limits["chars"] == (60, 60) and limits["bytes"][1] == 60 and None not in limits
    by = {r["source"]: (r["docs"], r["truncated"]) for r in truncation.truncation_by_source(df, "id", "source", "text").collect()}
    assert by["free"] == (300, 0) and by[None] == (2, 0) and by["bytes"] == (100, 50) and by["chars"][1] >= 100  # headings at the limit too
    assert {r["signal"] for r in truncation.truncation_signals(df, "id", "source", "text").collect()} == {"limit"}
    two = truncation.truncation_of_columns(df.withColumn("title", F.col("text")), "id", "source", ["text", "title"])
    assert two.count() == 8


def test_planted_runs_at_every_offset(spark, small):
    rng = random.Random(3)
    items = spark.read.parquet(f"{small}/eval_items.parquet")
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    fill = " ".join(r["text"] for r in documents.where("length(text) > 3000").orderBy("doc_id").limit(5).collect()).split()
    planted, rows = set(), []
    for r in items.orderBy("item_id").limit(12).collect():
        words = " ".join(leakage.lines_of(r["passage"])).split()
        starts = {}
        for i in range(len(words) - 1):
            starts.setdefault((words[i], words[i + 1]), []).append(i)
        for at in range(len(words) - 19):
            run = words[at : at + 20]
            long = [i for i in range(20) if len(run[i]) >= 4]
            for i in rng.sample(long, min(6, len(long))):  # one letter each
                c = rng.randrange(len(run[i]))
                run[i] = run[i][:c] + rng.choice("xzqkvj") + run[i][c + 1 :]
            begin = rng.randrange(len(fill) - 100)
            text = fill[begin : begin + 40 + at % 5] + run + fill[begin + 50 : begin + 100]
            if leakage.longest_run(words, text, set(), leakage.Matcher(), starts) >= 20:
                planted.add((10**9 + len(rows), r["item_id"]))
                rows.append((10**9 + len(rows), " ".join(text)))
    assert len(planted) > 100
    both = documents.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(both, "doc_id", "text", items, "item_id", "passage").collect()}
    assert not planted - found


def test_paraphrases(spark):
    words = PASSAGE.split()
    changed = " ".join({"over": "across", "while": "as"}.get(w, w) for w in words)  # no run of 20 words, most words in their order
    docs = [(1, NOISE + changed + " " + NOISE), (2, NOISE * 3), (3, NOISE + PASSAGE), (4, " ".join(sorted(words)))]
    docs += [(10 + i, NOISE + "walks over while bridge the") for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id int, passage string")
    rows = leakage.paraphrased_passages(df, "doc_id", "text", items, "item_id", "passage").collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(1, 1)] and rows[0]["words"] < 20 and rows[0]["common"] > 0.7
    assert leakage.common_subsequence("a b c d".split(), "x b a d".split()) == 2 and leakage.common_subsequence(["a"], []) == 0


def test_blocks_of_items_are_bounded():
    rows = [{"item_id": i, "passage": " ".join(f"w{i}x{j}" for j in range(40))} for i in range(1200)]
    blocks = list(leakage._item_blocks(iter(rows)))
    assert len(blocks) == 3 and sum(len(b.ids) for b in blocks) == 1200
    assert all(len(b.vocabulary) <= leakage.VOCABULARY for b in blocks)
