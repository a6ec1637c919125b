import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecloom.functions import text as T
from vecloom.functions import vector as V


def one(spark, schema, row, col):
    return spark.createDataFrame([row], schema).select(col.alias("v")).first()["v"]


def test_layer_sizes():
    assert V.layer_sizes(1000, 10) == [10, 100, 1000]
    assert V.layer_sizes(32, 2) == [1, 2, 4, 8, 16, 32]
    assert [V.elements_in_layer(10000, 10, i) for i in range(6)] == [1, 10, 100, 1000, 10000, 10000]
    assert [V.elements_in_layer(20, 1.9, i) for i in range(6)] == [2, 3, 6, 11, 20, 20]
    assert V.layer_sizes(10**9, 20) == [16, 313, 6250, 125000, 2500000, 50000000, 10**9]
    assert V.layer_sizes(50, 100) == [50]
    assert V.layer_sizes(133689866, 15) == [12, 177, 2641, 39612, 594178, 8912658, 133689866]
    assert V.layer_sizes(0, 15) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e3, 1e3, width=32), min_size=1, max_size=12))
def test_normalize_and_quantize(spark, v):
    x = np.array(v, "f4")
    n = np.linalg.norm(x.astype("f8"))
    got = one(spark, "v array<float>", (v,), V.normalize(F.col("v")))
    assert np.allclose(got, x / n if n > 0 else x, atol=1e-9)
    q = one(spark, "v array<float>", (v,), V.quantize(F.col("v")))
    top = np.abs(x).max()
    want = np.trunc(x * np.float32(127) / top).astype(int) if top > 0 else np.zeros(len(x), int)
    assert q == want.tolist()


def test_quantize_keeps_f32_truncation(spark):
    rng = np.random.default_rng(0)
    hit = 0
    for _ in range(20):
        x = rng.standard_normal(8).astype("f4")
        q = one(spark, "v array<float>", (x.tolist(),), V.quantize(F.col("v")))
        hit += max(map(abs, q)) in (126, 127)
    assert hit == 20


def test_distances(spark):
    s = "x array<float>, y array<float>"
    d = lambda x, y, f: one(spark, s, (x, y), f(F.col("x"), F.col("y")))
    assert d([1.0, 0.0], [1.0, 0.0], V.angular) == 0
    assert d([1.0, 0.0], [-1.0, 0.0], V.angular) == 2
    assert d([2.0, 0.0], [5.0, 0.0], V.angular_any) == 0
    assert d([0.0, 0.0], [0.0, 0.0], V.angular_any) == 1
    assert d([0.0, 0.0], [0.0, 0.0], V.angular_int) == 1
    assert d(None, [1.0], V.angular_any) is None
    assert d([3.0, 4.0], [4.0, 3.0], lambda x, y: V.distance("ANGULAR", x, y)) == pytest.approx(0.04, abs=1e-6)
    with pytest.raises(PySparkException):
        d([1.0], [1.0, 2.0], V.angular)
    with pytest.raises(ValueError):
        V.distance("other", F.col("x"), F.col("y"))


def test_indexable(spark):
    assert one(spark, "v array<float>", ([0.0, 0.0],), V.indexable(F.col("v"))) is False
    assert one(spark, "v array<float>", ([0.0, 3.0],), V.indexable(F.col("v"))) is True


def test_delta(spark):
    df = spark.createDataFrame([([1, 2, 2, 4],), ([],), ([7],)], "a array<long>")
    got = [tuple(r) for r in df.select(V.delta_encode(F.col("a")), V.delta_decode(V.delta_encode(F.col("a")))).collect()]
    assert got == [([1, 1, 0, 2], [1, 2, 2, 4]), ([], []), ([7], [7])]


def test_text(spark):
    assert one(spark, "t string", ('"a: b\\u00e9"',), T.json_text(F.col("t"))) == "a: bé"
    assert one(spark, "t string", ('"open',), T.json_text(F.col("t"))) is None
    assert one(spark, "t string", ('q"\\',), T.json_line(F.col("t"))) == '"q\\"\\\\"'
    assert one(spark, "t string", ("a:b: c",), T.after_last_colon(F.col("t"))) == " c"
    assert one(spark, "t string", (" a b  c ",), T.words(F.col("t"))) == ["a", "b", "c"]
    assert one(spark, "t string", ("tok 1.5 -2",), T.vector_of_line(F.col("t"))) == [1.5, -2.0]
    assert one(spark, "t string", ("tok 1.5 -2",), T.token_of_line(F.col("t"))) == "tok"


def test_shard_path(tmp_path):
    assert T.shard_path(str(tmp_path), 3) == f"{tmp_path}/elements-3.bin"
    assert T.shard_path("/x/out.dat", 1) == "/x/out-1.dat"
    assert T.shard_path("/x/out", 1) == "/x/out-1.bin"
