import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecloom import api
from vecloom.operators import embeddings as E
from vecloom.operators import ids
from vecloom.operators.layered import BuildConfig
from vecloom.sources import files
from vecloom.streaming.growing import GrowingIndex

WORDS = ["red", "green", "blue", "re\"d", "grün"]


@pytest.fixture()
def word_file(tmp_path):
    p = tmp_path / "words"
    p.write_text("".join(json.dumps(w) + "\n" for w in WORDS))
    return str(p)


def dictionary(spark):
    vecs = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [2.0, 0.0], [0.0, -1.0]]
    return spark.createDataFrame([(i, w, v) for i, (w, v) in enumerate(zip(WORDS, vecs))], "word_id int, word string, vec array<float>")


def test_word_file_round_trip(spark, word_file, tmp_path):
    read = files.words(spark, word_file)
    assert [(r["word_id"], r["word"]) for r in read.orderBy("word_id").collect()] == list(enumerate(WORDS))
    files.write_words(read, f"{tmp_path}/again")
    assert [r["word"] for r in files.words(spark, f"{tmp_path}/again/part*").orderBy("word_id").collect()] == WORDS
    bad = tmp_path / "bad"
    bad.write_text('"a"\nno json\n')
    with pytest.raises(PySparkException):
        files.words(spark, str(bad)).collect()


def test_element_files(spark, word_file, tmp_path):
    folder = tmp_path / "elements"
    folder.mkdir()
    (folder / "b").write_text('"blue"\n"x: red red unknown\\u00a0green"\n')
    with gzip.open(folder / "a.gz", "wt") as f:
        f.write('"k:gr\\u00fcn"\n""\n')
    parsed = E.parse_elements(files.element_lines(spark, str(folder)), "id", "value", E.word_dictionary(files.words(spark, word_file)))
    assert [(r["id"], r["term_ids"]) for r in parsed.orderBy("id").collect()] == [(0, [4]), (1, []), (2, [2]), (3, [0, 0, 1])]
    n = api.parse_elements_and_save(spark, str(folder), word_file, f"{tmp_path}/shards", 3)
    assert n == 4 and {r["shard"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/shards").groupBy("shard").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 2}


def test_sums(spark):
    terms = spark.createDataFrame([(0, [0, 1, 0]), (1, []), (2, None), (3, [99])], "id long, term_ids array<int>")
    got = {r["id"]: list(r["vec"]) for r in E.sum_embeddings(terms, dictionary(spark), 2).collect()}
    assert got == {0: [2.0, 1.0], 1: [0.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    q = {r["id"]: list(r["vec"]) for r in E.quantized_sums(terms, dictionary(spark), 2).collect()}
    assert q[1] == [0, 0] and q[0][0] in (126, 127)
    text = {r["id"]: r["text"] for r in E.element_words(terms, dictionary(spark)).collect()}
    assert text[0] == "red green red" and text[1] == ""


def test_words_last_id_wins(spark):
    words = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "word_id int, word string")
    assert {r["word"]: r["word_id"] for r in E.word_dictionary(words).collect()} == {"a": 2, "b": 1}


def test_binary_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "id long, vec array<float>")
    files.write_binary_vectors(df, f"{tmp_path}/v.bin")
    back = files.binary_vectors(spark, f"{tmp_path}/v.bin").orderBy("id").collect()
    assert [(r["id"], list(r["vec"])) for r in back] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    (tmp_path / "ragged").write_bytes((3).to_bytes(8, "little") + b"\0" * 8)
    with pytest.raises(PySparkException):
        files.binary_vectors(spark, f"{tmp_path}/ragged").collect()
    flat = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "f array<float>")
    assert [list(r["vec"]) for r in files.flat_vectors(flat, "f", 2).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(PySparkException):
        files.flat_vectors(flat, "f", 3).collect()


def test_binary_data_source(spark, tmp_path):
    from vecloom.sources.binary import BinaryVectors

    spark.dataSource.register(BinaryVectors)
    df = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(10)], "id long, vec array<float>")
    (tmp_path / "d").mkdir()
    files.write_binary_vectors(df.where("id < 4"), f"{tmp_path}/d/a")
    files.write_binary_vectors(df.where("id >= 4"), f"{tmp_path}/d/b")
    got = spark.read.format("flat_vectors").option("path", f"{tmp_path}/d").option("rows", 3).load()
    assert [(r["id"], list(r["vec"])) for r in got.orderBy("id").collect()] == [(i, [i, -i]) for i in range(10)]
    small = spark.createDataFrame([(0, [1, -127])], "id long, vec array<tinyint>")
    files.write_binary_vectors(small, f"{tmp_path}/i8", "tinyint")
    assert list(spark.read.format("flat_vectors").option("path", f"{tmp_path}/i8").option("dtype", "tinyint").load().first()["vec"]) == [1, -127]
    (tmp_path / "bad").write_bytes(b"\0" * 12)
    with pytest.raises(PySparkException):
        spark.read.format("flat_vectors").option("path", f"{tmp_path}/bad").load().collect()


def test_token_vectors_and_filters(spark, tmp_path):
    (tmp_path / "t.txt").write_text("cat 3 4\ndog 0 0\n")
    got = [(r["token"], [round(c, 6) for c in r["vec"]]) for r in files.token_vectors(spark, f"{tmp_path}/t.txt").orderBy("id").collect()]
    assert got == [("cat", [0.6, 0.8]), ("dog", [0.0, 0.0])]
    lists = spark.createDataFrame([(0, [3, 1, 2])], "id long, l array<long>")
    files.write_filtered(lists, f"{tmp_path}/f", "l", lambda x: x > 1, ordered=True)
    assert spark.read.parquet(f"{tmp_path}/f").first()["l"] == [2, 3]
    files.write_range(lists.withColumn("id", F.lit(5).cast("long")), f"{tmp_path}/r", 5, 6)
    assert spark.read.parquet(f"{tmp_path}/r").first()["id"] == 0


def test_numbered_and_concatenated(spark):
    df = spark.range(1000).withColumn("k", -F.col("id"))
    got = ids.numbered(df, "n", 5, "k").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(5, 1005)) and [r["id"] for r in got] == list(range(999, -1, -1))
    assert ids.numbered(df.where("id < 0"), "n", 0, "k").count() == 0
    a = spark.createDataFrame([(0, [1.0])], "id long, vec array<float>")
    assert sorted(r["id"] for r in ids.concatenated(a, a).collect()) == [0, 1]
    with pytest.raises(ValueError):
        ids.concatenated(a, spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<float>"))


def test_facade(spark, tmp_path):
    emb = api.Embeddings(spark, dictionary(spark))
    assert emb.get_embedding("red green") == [1.0, 1.0] and emb.get_embedding(0) == [1.0, 0.0] and emb.get_embedding([0, 1]) == [1.0, 1.0]
    assert emb.dist("red", "green") == pytest.approx(1) and emb.dists(0, [0, 4]) == pytest.approx([0, 1])
    assert emb.append([5.0, 5.0], "new") is True and emb.append([5.0, 5.0], "new") is False and len(emb) == 6
    builder = api.VectorIndexBuilder(spark, "embeddings", embeddings=emb, num_neighbors=4, max_search=10)
    for t in ("red", "green", "red green", "blue unknown"):
        builder.append(t)
    assert builder.num_elements() == 4 and len(builder) == 0
    index = builder.build()
    assert len(index) == 4 and index.search("red", 10, 1)[0][0] == "red"
    assert index.get_internal_element(2) == "red green" and index.get_terms(2) == [0, 1] and index.get_terms(77) is None
    assert emb.dists("red", ["green", 0, [0, 1], "nothing known"]) == pytest.approx([1, 0, 1 - 2**-0.5, 1])
    order = index.reorder()
    assert sorted(order) == [0, 1, 2, 3] and index.search("green", 10, 1)[0][0] == "green"
    vec = api.VectorIndexBuilder(spark, "angular_int", num_neighbors=4, max_search=10)
    for v in ([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]):
        vec.append(v)
    found = vec.build().search([1.0, 0.1], 10, 2)
    assert [i for i, _ in found] == [0, 1]
    assert api.compute_distance("angular", [1, 0], [-1, 0]) == pytest.approx(2)
    with pytest.raises(ValueError):
        api.VectorIndexBuilder(spark, "other")


def test_growing_index_from_a_stream(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(2).standard_normal((60, 6))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    spark.createDataFrame(rows[:30], "k long, vec array<float>").coalesce(1).write.parquet(f"{tmp_path}/in")
    g = GrowingIndex(spark, f"{tmp_path}/index", 50, BuildConfig(num_neighbors=8, max_search=30))
    assert g.search(spark.createDataFrame([(0, [1.0] * 6)], "query_id long, vec array<float>")).count() == 0
    stream = lambda: spark.readStream.schema("k long, vec array<float>").parquet(f"{tmp_path}/in")
    g.start(stream(), f"{tmp_path}/cp").awaitTermination()
    assert len(g) == 30 and g.state()["version"] == 1
    spark.createDataFrame(rows[30:], "k long, vec array<float>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    g.start(stream(), f"{tmp_path}/cp").awaitTermination()
    assert len(g) == 50  # the surplus is dropped
    assert sorted(r["id"] for r in g.snapshot().elements.collect()) == list(range(50))
    batch = g.state()["batch"]
    assert g.insert_batch(spark.createDataFrame(rows, "k long, vec array<float>"), batch).count() == 0  # a replay
    e = g.snapshot().elements.where("id = 10").select(F.col("id").alias("query_id"), "vec")
    assert g.search(e, 50, 1).first()["id"] == 10


def test_sums_by_join_equal_gathered_ones(spark, monkeypatch):
    terms = spark.createDataFrame([(0, [0, 1, 0]), (1, []), (2, None), (3, [99, None, 2]), (4, list(range(5)) * 40_000)], "id long, term_ids array<int>")
    gathered = {r["id"]: list(r["vec"]) for r in E.sum_embeddings(terms, dictionary(spark), 2).collect()}
    monkeypatch.setattr(E, "DICTIONARY_BYTES", 16)
    assert {r["id"]: list(r["vec"]) for r in E.sum_embeddings(terms, dictionary(spark), 2).collect()} == gathered
    assert gathered[4] == [160_000.0, 40_000.0] and gathered[3] == [1.0, 1.0]
    none = dictionary(spark).where("word_id > 99")
    monkeypatch.undo()
    assert all(v == [0.0, 0.0] for v in (list(r["vec"]) for r in E.sum_embeddings(terms, none, 2).collect()))


def test_lines_of_files_that_are_split(spark, tmp_path):
    lines = [json.dumps(f"line {i}") for i in range(5000)]
    (tmp_path / "big").write_text("\n".join(lines))  # no newline at the end
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [r["value"] for r in files.element_lines(spark, f"{tmp_path}/big").orderBy("id").collect()]
        ids_ = [r["id"] for r in files.element_lines(spark, f"{tmp_path}/big").orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == lines and ids_ == list(range(5000))


def test_versions_of_a_growing_index(spark, tmp_path):
    import os

    g = GrowingIndex(spark, f"{tmp_path}/i", 100, BuildConfig(num_neighbors=6, max_search=20))
    for k in range(5):
        rows = [(float(k), float(j), 1.0) for j in range(4)]
        g.insert_batch(spark.createDataFrame([([*r],) for r in rows], "vec array<float>"), k)
    assert len(g) == 20 and len(g.snapshot()) == 20
    full = GrowingIndex(spark, f"{tmp_path}/j", 1, BuildConfig(num_neighbors=6, max_search=20))
    assert full.insert([1.0, 2.0]) == 0 and full.insert([2.0, 1.0]) is None and len(full) == 1
    assert sorted(n for n in os.listdir(tmp_path / "i") if n.startswith("v")) == ["v3", "v4", "v5"]


def test_a_dictionary_counts_in_its_own_precision(spark, monkeypatch):
    words = spark.createDataFrame([(i, [float(i)] * 8) for i in range(10)], "word_id int, vec array<float>")
    terms = spark.createDataFrame([(0, [1, 2, 2]), (1, [99])], "id long, term_ids array<int>")
    monkeypatch.setattr(E, "DICTIONARY_BYTES", 10 * (8 + 4 * 8))
    monkeypatch.setattr(E, "joined_sums", None)
    assert {r["id"]: list(r["vec"]) for r in E.sum_embeddings(terms, words, 8).collect()} == {0: [5.0] * 8, 1: [0.0] * 8}
