import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from against_sql import compare

from vecloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    compare(spark, small, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "id", "dist"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_distances_of_a_large_table(spark, tmp_path):
    n = (1 << 20) + 7
    x = np.stack([np.ones(n), np.arange(n) / n], 1).astype("f4")
    vecs = pa.ListArray.from_arrays(np.arange(0, 2 * n + 1, 2, dtype="i4"), x.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(n), "label": np.zeros(n, "i4"), "embedding": vecs}), tmp_path / "embeddings.parquet")
    far = catalog.queries()["dists_to_first"](spark, str(tmp_path)).selectExpr("count(*) as n", "max_by(id, dist) as far", "max(dist) as dist").first()
    assert far["n"] == n and abs(far["dist"] - (1 - 1 / 2**0.5)) < 1e-5


def test_graphs_of_all_nodes(spark, tmp_path):
    n, k = 61, 20
    x = np.random.default_rng(2).standard_normal((n, 8)).astype("f4")
    vecs = pa.ListArray.from_arrays(np.arange(0, 8 * n + 1, 8, dtype="i4"), x.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(n), "label": np.arange(n, dtype="i4") % 3, "embedding": vecs}), tmp_path / "embeddings.parquet")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 9)
    order = np.argsort(d, 1)
    edges = {(i, int(j)) for i in range(n) for j in order[i, :k]}
    both = edges | {(j, i) for i, j in edges}

    def rows(name, *columns):
        return {tuple(r) for r in catalog.queries()[f"{name}_whole"](spark, str(tmp_path)).select(*columns).collect()}

    assert rows("knn_graph_symmetric", "node", "nbr") == both
    assert rows("knn_graph_degrees", "node", "degree") == {(i, sum(a == i for a, _ in both)) for i in range(n)}
    assert rows("neighbors_roundtrip", "node", "nbr") == edges
    assert rows("neighbors_filtered", "node", "nbr") == {e for e in edges if e[1] % 2 == 0}
    deltas = {}
    for node, pos, delta in sorted(rows("neighbors_delta_long", "node", "pos", "delta")):
        deltas.setdefault(node, []).append(delta)
    assert {(i, int(j)) for i, v in deltas.items() for j in np.cumsum(v)} == edges
    new = {r["old_id"]: r["new_id"] for r in catalog.queries()["reorder_by_keys"](spark, str(tmp_path)).collect()}
    assert rows("reordered_neighbors", "node", "nbr") == {(new[a], new[b]) for a, b in edges}
    kept = set()
    for i in range(n):
        own = []
        for j in order[i, :50].tolist():
            if len(own) < 10 and all(d[i, j] <= d[o, j] for o in own):
                own.append(j)
        kept |= {(i, j, pos) for pos, j in enumerate(own)}
    assert rows("select_neighbors_10", "node", "id", "pos") == kept
