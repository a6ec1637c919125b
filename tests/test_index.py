import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import exact, reorder
from vecloom.operators.index import Index, IndexBuilder, neighbour_invariants
from vecloom.operators.layered import NONE, BuildConfig, Searcher, build, select


def unit(n, dim, seed=0):
    x = np.random.default_rng(seed).random((n, dim)) - 0.5
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<float>")


def precision(x, layers, max_search):
    s = Searcher(x, layers)
    return np.mean([s.search(v, max_search, 1)[0][1] == i for i, v in enumerate(x)])


@pytest.mark.parametrize("n,dim,config,search", [(1500, 28, dict(num_neighbors=20, max_search=20), 10), (500, 32, dict(num_neighbors=20, max_search=20), 10), (500, 25, dict(num_neighbors=20, max_search=5, reinsert=False), 40)])
def test_precision(n, dim, config, search):
    x = unit(n, dim)
    assert precision(x, build(x, BuildConfig(**config)), search) > 0.95


def test_incremental_layers():
    x = unit(1000, 5)
    config = BuildConfig(layer_multiplier=10, num_neighbors=20, max_search=50)
    layers, sizes = [], []
    for n in (12, 102, 1000):
        layers = build(x, config, layers, n)
        sizes.append([len(k) for k in layers])
    assert sizes == [[10, 12], [10, 100, 102], [10, 100, 1000]]
    assert precision(x, layers, 40) > 0.95
    with pytest.raises(ValueError):
        build(x, config, layers, 5)


def test_degenerate_shards():
    config = BuildConfig(num_neighbors=4, max_search=10)
    assert build(np.empty((0, 3)), config) == []
    one = build(unit(1, 3), config)
    assert [len(k) for k in one] == [1] and (one[0] == NONE).all()
    assert Searcher(unit(1, 3), one).search(unit(1, 3)[0], 5, 3) == [(0.0, 0)]
    zero = np.vstack([np.zeros((1, 3)), unit(20, 3)])
    layers = build(zero, config)
    assert (layers[-1][0] == NONE).all() and not (layers[-1] == 0).any()
    assert Searcher(zero, layers).search(zero[5], 20, 1)[0][1] == 5
    same = np.repeat(unit(1, 3), 30, axis=0)  # more copies than half of the degree: dead nodes
    assert (build(same, config)[-1][2:] == NONE).all()  # the two of the first layer have each other


def test_select_keeps_all_when_few():
    x = unit(50, 50)
    d = 1 - x @ x[0]
    order = np.argsort(d)[1:]
    ids, dist = order[None, :].astype("i4"), d[order][None, :]
    assert (select(x, ids, dist, 60)[0, :49] == order).all()
    few = select(x, ids, dist, 10)[0]
    few = few[few != NONE]
    assert 1 <= len(few) <= 10 and (np.diff(d[few]) >= 0).all()


def test_config():
    for bad in (dict(num_neighbors=0), dict(num_neighbors=255), dict(max_search=0), dict(layer_multiplier=1.0)):
        with pytest.raises(ValueError):
            BuildConfig(**bad)


def test_search_shards_and_store(spark, tmp_path):
    x = unit(600, 16)
    df = frame(spark, x)
    config = BuildConfig(num_neighbors=12, max_search=40)
    index = IndexBuilder(df, config, shards=3).build()
    got = index.search(df.where("id % 20 = 0"), 60, 5, query_id="id")
    want = exact.knn(df.where("id % 20 = 0"), df, 5)
    hit = got.join(want.select(F.col("query_id").alias("q"), F.col("id").alias("i")), (F.col("query_id") == F.col("q")) & (F.col("id") == F.col("i"))).count()
    assert hit / want.count() > 0.95
    assert len(index) == 600 and index.num_elements() == 600
    stats = neighbour_invariants(index).collect()
    assert all(r["loops"] == r["over_degree"] == r["dangling"] == 0 for r in stats)
    index.save(f"{tmp_path}/i")
    again = Index.load(spark, f"{tmp_path}/i")
    assert again.header() == index.header()
    assert sorted(again.search(df.where("id = 7"), 60, 5, query_id="id").collect()) == sorted(index.search(df.where("id = 7"), 60, 5, query_id="id").collect())
    less = IndexBuilder.resume(again, BuildConfig(num_neighbors=3)).get_index()
    assert less.graph.agg(F.max(F.size("neighbors"))).first()[0] <= 3
    assert index.search(df.where("id = 7"), 2, 5, query_id="id").count() == 2
    with pytest.raises(ValueError):
        index.search(df, 0, 5, query_id="id")


def test_append_and_partial(spark):
    x = unit(400, 12)
    config = BuildConfig(layer_multiplier=10, num_neighbors=10, max_search=30, expected=400)
    builder = IndexBuilder(frame(spark, x[:200]), config, shards=1)
    assert builder.build_partial(0).num_layers() == 0
    index = builder.build()
    assert len(index) == 200
    index = builder.append(frame(spark, x[200:], 200)).build()
    assert len(index) == 400 and index.layer_counts() == [4, 40, 400]
    assert index.search(frame(spark, x[300:301], 300), 40, 1, query_id="id").first()["id"] == 300
    assert index.get_neighbors(5) == sorted(index.get_neighbors(5)) and index.get_element(5) is not None


def test_empty_index(spark):
    empty = spark.createDataFrame([], "id long, vec array<float>")
    index = IndexBuilder(empty).build()
    assert index.num_layers() == 0 and len(index) == 0
    assert index.search(frame(spark, unit(1, 3)), 5, 5, query_id="id").count() == 0


def test_reorder_gives_the_same_results(spark):
    x = unit(500, 5)
    df = frame(spark, x)
    index = IndexBuilder(df, BuildConfig(layer_multiplier=5, num_neighbors=10, max_search=20), shards=1).build()
    moved, perm = reorder.reordered_index(index)
    to_old = {r["new_id"]: r["old_id"] for r in perm.collect()}
    assert sorted(to_old) == sorted(to_old.values()) == list(range(500))
    q = df.where("id < 20")
    a = {(r["query_id"], r["rank"]): r["id"] for r in index.search(q, 500, 5, query_id="id").collect()}
    b = {(r["query_id"], r["rank"]): to_old[r["id"]] for r in moved.search(q, 500, 5, query_id="id").collect()}
    assert a == b
    back = reorder.permuted(reorder.permuted(df, perm), reorder.reverse_mapping(perm))
    assert sorted(map(tuple, ((r["id"], tuple(r["vec"])) for r in back.collect()))) == sorted((r["id"], tuple(r["vec"])) for r in df.collect())


def test_permutation_direction(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, v string")
    perm = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "new_id long, old_id long")
    assert [r["v"] for r in reorder.permuted(rows, perm).orderBy("id").collect()] == ["b", "c", "a"]


def test_exact_with_a_distance_of_ones_own(spark):
    df = frame(spark, np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 5.0]]))
    l1 = lambda q, x: np.abs(q[:, None, :] - x[None, :, :]).sum(2)
    got = [(r["id"], r["dist"]) for r in exact.knn(df.where("id = 0"), df, 3, distance=l1).orderBy("rank").collect()]
    assert got == [(0, 0.0), (1, 1.0), (2, 10.0)]


def test_exact_ties_nulls_and_zero(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None), (None, [1.0, 0.0])], "id long, vec array<float>")
    got = [tuple(r) for r in exact.knn(df.where("id = 3"), df, 3).orderBy("rank").collect()]
    assert got == [(3, 1, 1, 0.0), (3, 2, 3, 0.0), (3, 3, 2, 1.0)]
    assert exact.knn(df.where("id = 99"), df, 3).count() == 0


def test_exact_with_many_queries(spark, monkeypatch):
    x = unit(300, 8)
    df = frame(spark, x).unionByName(spark.createDataFrame([(900, [0.0] * 8), (901, None), (None, [1.0] * 8)], "id long, vec array<float>"))
    few = sorted(tuple(r) for r in exact.knn(df, df, 4, exclude_self=True).collect())
    monkeypatch.setattr(exact, "QUERY_BLOCK", 40)
    assert sorted(tuple(r) for r in exact.knn(df, df, 4, exclude_self=True).collect()) == few and len(few) == 301 * 4
    assert exact.knn(df, df.where("id > 9999"), 4).count() == 0


def test_exact_holds_no_more_than_a_tile_of_distances(spark):
    def small_tiles(q, x):
        if q.shape[0] * x.shape[0] > 1 << 20:
            raise MemoryError("too many distances at once")
        return exact.cosine_distance(q, x)

    df = frame(spark, unit(3000, 4)).coalesce(1)
    own = exact.knn(df, df, 3, distance=small_tiles)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, exact.knn(df, df, 3).collect()))


def test_exact_of_blocks_of_queries_is_that_of_all(spark, monkeypatch):
    x = unit(400, 8)
    x[::50], x[1::40] = 0, x[2]  # without direction, and equal ones
    df = frame(spark, x)
    d = np.round(exact.cosine_distance(x, x), exact.DIGITS)
    d[np.arange(400), np.arange(400)] = np.inf
    want = [(i, n + 1, int(j)) for i in range(400) for n, j in enumerate(np.lexsort((np.arange(400), d[i]))[:4])]
    found = lambda: sorted(tuple(r)[:3] for r in exact.knn(df, df, 4, exclude_self=True).collect())
    monkeypatch.setattr(exact, "QUERY_BLOCK", 40)
    assert found() == want  # counted, and sent
    monkeypatch.setattr(exact, "QUERY_BYTES", 100 * (8 * 8 + 16 * 4))
    assert found() == want  # blocks of 100


def test_search_blocks_equal_single_searches():
    x = unit(900, 12)
    s = Searcher(x, build(x, BuildConfig(num_neighbors=12, max_search=40)))
    ids, dist = s.search_block(x[:150], 60, 5)
    single = [s.search(v, 60, 5) for v in x[:150]]
    assert np.mean([[p for _, p in one] == ids[i].tolist() for i, one in enumerate(single)]) > 0.97
    assert all(dist[i, 4] <= one[4][0] + 1e-12 for i, one in enumerate(single))  # never worse
    assert (Searcher(np.empty((0, 3)), []).search_block(x[:2, :3], 5, 3)[0] == NONE).all()
    with pytest.raises(ValueError):
        s.search_block(x[:1], 0, 1)


def test_partial_over_shards_takes_the_smallest_ids(spark):
    df = frame(spark, unit(500, 6)).withColumn("id", F.col("id") * 7 - 1000)
    builder = IndexBuilder(df, BuildConfig(layer_multiplier=8, num_neighbors=8, max_search=20), shards=4)
    for n in (1, 130, 131, 500, 700):
        index = builder.build_partial(n)
        got = sorted(r["node"] for r in index.last_layer().select("node").collect())
        assert got == [i * 7 - 1000 for i in range(min(n, 500))]


def test_reorder_of_several_shards(spark):
    x = unit(400, 5)
    df = frame(spark, x)
    index = IndexBuilder(df, BuildConfig(layer_multiplier=5, num_neighbors=10, max_search=20), shards=3).build()
    moved, perm = reorder.reordered_index(index)
    to_old = {r["new_id"]: r["old_id"] for r in perm.collect()}
    assert sorted(to_old) == sorted(to_old.values()) == list(range(400)) and any(a != b for a, b in to_old.items())
    assert moved.layer_counts() == index.layer_counts()
    q = df.where("id < 20")
    a = {(r["query_id"], r["rank"]): r["id"] for r in index.search(q, 400, 5, query_id="id").collect()}
    b = {(r["query_id"], r["rank"]): to_old[r["id"]] for r in moved.search(q, 400, 5, query_id="id").collect()}
    assert a == b
