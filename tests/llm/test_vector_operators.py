"""Varied subset, nearest vectors, similarity groups: edge cases and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import clusters, graph, neighbours, queries, subset, vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grouped(groups=6, members=40, loose=150, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = unit(rng.standard_normal((groups, dim)))
    x = np.vstack([unit(c + 0.15 / np.sqrt(dim) * rng.standard_normal((members, dim))) for c in centres] + [unit(rng.standard_normal((loose, dim)))])
    return x.astype("f4")


def frame(spark, x, scale=True):
    rows = [(i, [float(c) * (1 + i % 3 if scale else 1) for c in v], "k", 0) for i, v in enumerate(x)]
    rows += [(10_000, None, "k", 0), (10_001, [0.0] * x.shape[1], "k", 0), (10_002, [1.0], "k", 0), (None, rows[0][1], "k", 0), (10_003, [float("nan")] * x.shape[1], "k", 0), (10_004, [], "k", 0)]
    rows += rows[:10]  # delivered twice
    return spark.createDataFrame(rows, "id long, vec array<float>, shard string, rep int")


@pytest.fixture(scope="module")
def data():
    return grouped()


def truth(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, 1, kind="stable")[:, :k], s


def empty(spark):
    return spark.createDataFrame([], "id long, vec array<float>")


def test_groups_equal_brute_force(spark, data):
    got = {(r["lead_id"], r["id"]) for r in clusters.similarity_groups(frame(spark, data), "id", "vec").collect()}
    near = data @ data.T >= 0.85
    want = set()
    for i in range(len(data)):
        g = np.flatnonzero(near[i])
        if len(g) >= 8 and all((np.flatnonzero(near[j]) == g).all() if near[j].sum() == len(g) else False for j in g):
            want.add((int(g[0]), i))
    assert got == want and len(want) == 240
    assert clusters.similarity_groups(empty(spark), "id", "vec").count() == 0
    same = spark.range(30).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    assert clusters.similarity_groups(same, "id", "vec").count() == 30
    few = clusters.described_groups(clusters.similarity_groups(frame(spark, data), "id", "vec"), 3).collect()
    assert len(few) == 6 and all(r["size"] == 40 and len(r["typical"]) == 3 for r in few)


def test_groups_that_seeding_misses(spark, data):
    # as few centres as this leave groups without one: the second step finds them
    got = clusters.similarity_groups(frame(spark, data), "id", "vec", k=2)
    assert got.groupBy("lead_id").count().count() == 6


def test_groups_missed_in_a_crowded_cell(spark):
    x = grouped(groups=20, members=8, loose=8000, dim=24, seed=9)
    rows = [(i, x[i].tolist()) for i in np.random.default_rng(1).permutation(len(x)).tolist()]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        found = clusters._missed(df, 24, x[-1:], np.empty((0, 24), "f4"), 0.15)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((x[8 * g : 8 * g + 8] @ found.T >= 0.85).any() for g in range(20))


def test_chain_is_no_group(spark):
    angles = np.linspace(0, 1.2, 40)
    x = np.stack([np.cos(angles), np.sin(angles)], 1).astype("f4")
    assert clusters.similarity_groups(frame(spark, x, False), "id", "vec").count() == 0


def test_groups_of_tables(spark, small):
    got = {tuple(r) for r in queries.p6_found(spark, small).collect()}
    want = set()
    for tab, key in queries.VECTOR_TABLES.items():
        rows = {r[0]: r[1] for r in spark.read.parquet(f"{small}/{tab}.parquet").where("vec is not null").select(key, "vec").collect() if any(r[1])}
        ids = np.array(list(rows))
        x = unit(np.array(list(rows.values()), "f8"))
        near = x @ x.T >= 0.85
        for i in range(len(ids)):
            g = ids[near[i]]
            if len(g) >= 8 and ids[i] != g.min():
                want.add((tab, int(g.min()), int(ids[i])))
    assert got == want


def test_nearest_equal_brute_force(spark, data):
    found = neighbours.nearest(frame(spark, data), "id", "vec", k=5)
    rows = {}
    for r in found.orderBy("id", "rank").collect():
        rows.setdefault(r["id"], []).append(r["near_id"])
    want, _ = truth(data, 5)
    assert set(rows) == set(range(len(data))) and all(len(v) == 5 for v in rows.values())
    assert np.mean([len(set(rows[i]) & set(want[i].tolist())) / 5 for i in rows]) > 0.99
    assert neighbours.recall(frame(spark, data), "id", "vec", found, k=5, every=7) > 0.99
    assert neighbours.nearest(empty(spark), "id", "vec").count() == 0


def test_nearest_over_shards(spark, data):
    found = neighbours.nearest(frame(spark, data), "id", "vec", k=5, shard_rows=100, visits=4)
    assert neighbours.recall(frame(spark, data), "id", "vec", found, k=5, every=3) >= 0.9


def test_nearest_is_complete_over_many_shards(spark):
    x = np.vstack([grouped(loose=600, seed=4), grouped(loose=0, members=3, seed=8)])
    x = np.vstack([x, np.repeat(x[300:302], 15, axis=0)])
    found = {}
    for r in neighbours.nearest(frame(spark, x), "id", "vec", k=5, shard_rows=25, visits=1).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["dist"])
    want, s = truth(x, 5)
    assert set(found) == set(range(len(x)))
    assert all(np.allclose(found[i], np.maximum(0, 1 - s[i, want[i]]), atol=3e-6) for i in found)


def test_copies_and_ties(spark):
    x = unit(np.random.default_rng(3).standard_normal((40, 8))).astype("f4")
    many = np.vstack([x, np.repeat(x[:1], 60, axis=0)])  # more copies than k of one vector
    df = frame(spark, many, False)
    pairs = {tuple(r) for r in neighbours.near_pairs(df, "id", "vec", 0.003).collect()}
    copies = [0, *range(40, 100)]
    near = {frozenset((a, b)) for a in copies for b in [c for c in copies if c != a][:10]}
    assert pairs == {(min(p), max(p)) for p in near}
    lists = {}
    for r in neighbours.nearest(df, "id", "vec", k=10).orderBy("id", "rank").collect():
        lists.setdefault(r["id"], []).append((r["near_id"], r["dist"]))
    assert [i for i, _ in lists[50]] == [c for c in copies if c != 50][:10] and lists[50][0][1] == 0
    assert all(len(v) == 10 for v in lists.values())


def test_pairs_across_shards(spark, data):
    rng = np.random.default_rng(5)
    close = unit(data + 0.01 / np.sqrt(data.shape[1]) * rng.standard_normal(data.shape)).astype("f4")
    x = np.vstack([data, close])
    want, s = truth(x, 10)
    pairs = {tuple(r) for r in neighbours.near_pairs(frame(spark, x), "id", "vec", 0.003, shard_rows=60).collect()}
    assert pairs == {(min(i, j), max(i, j)) for i in range(len(x)) for j in want[i].tolist() if s[i, j] >= 0.997}


def test_near_vectors_visit_each_other(spark):
    x = unit(np.random.default_rng(6).standard_normal((1500, 3))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    routes = neighbours.fitted_routes(df, 3, len(x), 100)
    home, at = {}, {}
    for r in neighbours._routed(df, 3, routes, 10, 4, 0.003).where("shard >= 0").select("id", "shard", "home").collect():
        at.setdefault(r["id"], set()).add(r["shard"])
        if r["home"]:
            home[r["id"]] = r["shard"]
    near = np.argwhere(x @ x.T >= 0.997)
    assert any(home[i] != home[j] for i, j in near.tolist())
    assert all(home[j] in at[i] for i, j in near.tolist())


def test_pairs_of_tables(spark, small):
    got = {tuple(r) for r in queries.p2_found(spark, small).collect()}
    want = set()
    for tab, key in queries.VECTOR_TABLES.items():
        rows = {r[0]: r[1] for r in spark.read.parquet(f"{small}/{tab}.parquet").where("vec is not null").select(key, "vec").collect() if any(r[1])}
        ids = np.array(list(rows))
        top, s = truth(unit(np.array(list(rows.values()), "f8")), 10)
        want |= {(tab, int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in range(len(ids)) for j in top[i].tolist() if s[i, j] >= 0.997}
    assert got == want


def test_graph_of_a_shard():
    rng = np.random.default_rng(0)
    x = unit(rng.standard_normal((900, 16))).astype("f4")
    ids, sims = graph.shard_neighbours(x, 700, 10)
    s = x @ x[:700].T
    s[np.arange(700), np.arange(700)] = -9
    want = np.argsort(-s, 1)[:, :10]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 10 for a, b in zip(ids, want)]) > 0.995
    edges = graph.robust_prune(x, ids[:700], sims[:700], 6)
    assert (edges[:, 0] == ids[:700, 0]).all() and edges.shape[1] == 6
    assert graph.shard_neighbours(x[:1], 1, 5)[0].tolist() == [[-1] * 5]
    assert graph.shard_neighbours(np.repeat(x[:1], 500, 0), 500, 5)[0].shape == (500, 5)


def test_quotas():
    counts = np.array([[1000, 1000], [3, 2], [50, 0]])
    q = subset.flow_quotas(counts, 30)
    assert q.sum() == 30 and (q <= counts).all() and q[1].sum() == 5
    assert abs(q[0].sum() - q[2].sum()) <= 1  # what the thin region cannot fill is shared evenly
    assert (subset.flow_quotas(counts, 10**6) == counts).all()
    assert subset.flow_quotas(counts, 0).sum() == 0
    large = subset.flow_quotas(counts * 1000, 100_000)
    assert large.sum() == 100_000


def test_subset(spark, data):
    crowd = np.vstack([data, np.repeat(data[:1], 1000, 0)])
    rows = subset.varied_subset(frame(spark, crowd), "id", "vec", size=60).collect()
    ids = [r["id"] for r in rows]
    assert len(ids) == len(set(ids)) == 60
    assert sum(i == 0 or i >= len(data) for i in ids) < 15  # most rows are one vector, few of the subset
    assert len({i // 40 for i in ids if i < 240}) == 6
    again = subset.varied_subset(frame(spark, crowd), "id", "vec", size=60).collect()
    assert sorted(ids) == sorted(r["id"] for r in again)
    assert subset.varied_subset(frame(spark, data), "id", "vec", size=10**6).count() == len(data)
    assert subset.varied_subset(empty(spark), "id", "vec", size=5).count() == 0


def test_subset_reaches_every_group(spark):
    # more groups than a quarter of the size, among more loose vectors
    x = grouped(groups=50, members=12, loose=500, dim=48, seed=2)
    ids = [r["id"] for r in subset.varied_subset(frame(spark, x), "id", "vec", size=80).collect()]
    assert len(set(ids)) == len(ids) == 80 and {i // 12 for i in ids if i < 600} == set(range(50))


def test_quotas_leave_no_region_out():
    counts = np.zeros((40, 8), "i8")
    counts[:20, 0], counts[20:] = 1, 500  # thin regions share one side
    assert (subset.flow_quotas(counts, 40).sum(1) == 1).all()
    assert (subset.flow_quotas(counts, 20_000).sum(1) >= 1).all()
    assert subset.flow_quotas(counts, 20)[:20].sum() == 0  # size for half: those with most records


def test_hashed_features(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, []), (5, None), (None, ["a"])], "id long, terms array<string>")
    got = {r["id"]: list(r["vec"]) for r in vectors.hashed_features(df, "id", "terms", 16).collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] != got[3] and len(got[1]) == 16


def test_the_graph_decides_what_is_found():
    rng = np.random.default_rng(1)
    x = unit(rng.standard_normal((2000, 16))).astype("f4")
    built = graph.ShardGraph(x)
    want, _ = truth(x, 10)
    hits = lambda ids: np.mean([len(set(a.tolist()) & set(b.tolist())) / 10 for a, b in zip(ids, want)])
    assert hits(built.nearest(None, 10)[0]) > 0.95
    edges = built.edges.pruned
    assert (edges != graph.NONE).sum(1).max() <= graph.DEGREE and not (edges == np.arange(2000)[:, None]).any()
    built.edges = graph.Edges(2000, graph.DEGREE)
    assert (built.nearest(None, 10)[0] == graph.NONE).all()  # no edges: nothing is reached


def test_crowded_shards_are_divided_and_dealt(spark, monkeypatch):
    x = grouped(groups=3, members=300, loose=100, dim=16, seed=5)
    monkeypatch.setattr(neighbours, "SEARCH_ROWS", 60)
    df = frame(spark, np.vstack([x, np.repeat(x[:1], 400, axis=0)]))
    vecs = vectors.selected(df, "id", "vec")
    dim, n = vectors.dimension_and_count(vecs)
    routes = neighbours.Routes(x[[0, 300, 600]], np.arange(3), 3)  # one centre to a group: no halving
    deal = neighbours._expected(x, routes, n, None, None, 15)
    assert deal.divided.max() > 4 and deal.copies.max() > 1 and deal.tasks == (deal.divided * deal.copies).sum()
    rows = neighbours._routed(vecs, dim, routes, 5, None, None, deal)
    per = {(r["unit"], r["kind"]): r["n"] for r in rows.groupBy("unit", "kind").count().withColumnRenamed("count", "n").collect()}
    assert max(n for (_, kind), n in per.items() if kind <= neighbours.HELD) < 300
    monkeypatch.setattr(neighbours, "_fitted", lambda *a: routes)
    found = {}
    for r in neighbours.nearest(df, "id", "vec", k=5, shard_rows=15, complete=False).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["dist"])
    whole = np.vstack([x, np.repeat(x[:1], 400, axis=0)])
    want, s = truth(whole, 5)
    assert set(found) == set(range(len(whole)))
    assert np.mean([np.allclose(found[i], np.maximum(0, 1 - s[i, want[i]]), atol=3e-6) for i in found]) > 0.95


@pytest.mark.parametrize("shard_rows", [400, 100])
def test_recall_over_shards(spark, data, shard_rows):
    df = frame(spark, data)
    found = neighbours.nearest(df, "id", "vec", k=10, shard_rows=shard_rows, complete=False)
    assert neighbours.recall(df, "id", "vec", found, k=10, every=3) >= 0.9


def test_leads_of_groups_and_chains():
    x = grouped(groups=4, members=6, loose=5, dim=24, seed=3)
    leads = clusters._Leads.of(x, 0.15)
    assert len(set(leads.group[:24].tolist())) == 4 and all(len(set(leads.group[6 * g : 6 * g + 6].tolist())) == 1 for g in range(4))
    assert not leads.broken.any() and len(leads.centres) == 9
    angles = np.linspace(0, 1.2, 12)
    chain = clusters._Leads.of(np.stack([np.cos(angles), np.sin(angles)], 1).astype("f4"), 0.15)
    assert len(chain.broken) == 1 and chain.broken.all()


def test_typical_members_are_nearest_the_centroid(spark, data):
    found = clusters.described_groups(clusters.similarity_groups(frame(spark, data), "id", "vec"), 3).collect()
    for r in found:
        g = np.arange(r["lead_id"], r["lead_id"] + 40)
        centroid = data[g].mean(0)
        near = g[np.argsort(-(data[g] @ centroid))[:3]]
        assert r["typical"] == near.tolist()


def test_clusters_of_all_rows(spark, data):
    assert clusters.clustered(frame(spark, data), "id", "vec", k=12).count() == len(data)
    once = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<float>")
    rows = clusters.clustered(once, "id", "vec", k=12)
    got = {r["id"]: (r["cluster"], r["d"]) for r in rows.collect()}
    assert set(got) == set(range(len(data)))
    where = np.array([got[i][0] for i in range(len(data))])
    for c in np.unique(where):
        mean = unit(data[where == c].mean(0, keepdims=True))[0]
        assert np.allclose([got[i][1] for i in np.flatnonzero(where == c)], np.maximum(0, 1 - data[where == c] @ mean), atol=1e-5)
    assert clusters.clustered(empty(spark), "id", "vec").count() == 0
