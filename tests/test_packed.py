import numpy as np
import pytest
from pyspark.errors import PySparkException

from vecloom.sources import packed as P


def test_ints():
    for width, most in ((3, (1 << 24) - 1), (5, (1 << 40) - 1)):
        values = np.array([0, 1, 255, 256, most], "u8")
        data = P.pack_ints(values, width)
        assert len(data) == 5 * width and (P.unpack_ints(data, width) == values).all()
        with pytest.raises(ValueError):
            P.pack_ints([most + 1], width)
        with pytest.raises(ValueError):
            P.unpack_ints(b"\0" * (width + 1), width)
    assert P.pack_ints([0x010203], 3) == b"\x03\x02\x01"


def test_sets():
    rng = np.random.default_rng(0)
    cases = [[], [5], [0, 0, 1], [2**32 - 1], [7] * 255, [1, 2, 2, 4], *(rng.integers(0, 2 ** rng.integers(1, 33), rng.integers(0, 256)).tolist() for _ in range(200))]
    for some in cases:
        data = P.pack_set(some)
        assert data[0] == len(some) and P.unpack_set(data).tolist() == sorted(some)
        assert len(data) <= 1 + 4 * len(some)
    assert P.pack_set([1, 2, 2, 4]) == bytes([4, 0, 1, 1, 0, 2])
    with pytest.raises(ValueError):
        P.pack_set(range(256))


def test_offsets():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 61, 120, 500):
        offsets = np.cumsum(rng.integers(0, 60_000, n))
        data = P.pack_offsets(offsets)
        assert len(data) % 128 == 0 and (P.unpack_offsets(data) == offsets).all()
    for bad in ([5, 4], [0, 70_000]):
        with pytest.raises(ValueError):
            P.pack_offsets(np.array(bad))


@pytest.mark.parametrize("sizes", [[], [1], [59, 60], [61, 119, 120, 700]])
def test_files(spark, tmp_path, sizes):
    rng = np.random.default_rng(2)
    layers = [[rng.integers(0, n, rng.integers(0, 30)).tolist() for _ in range(n)] for n in sizes]
    path = f"{tmp_path}/g"
    P.write_packed(path, layers, "tag", num_neighbors=30)
    want = [[sorted(some) for some in layer] for layer in layers]
    assert [[r.tolist() for r in layer] for layer in P.from_bytes(open(path, "rb").read(), "tag")] == want
    spark.dataSource.register(P.PackedGraph)
    rows = spark.read.format("packed_graph").option("path", path).option("tag", "tag").option("nodes", 120).load().collect()
    assert {(r["layer"], r["node"]): r["neighbors"] for r in rows} == {(k, i): some for k, layer in enumerate(want) for i, some in enumerate(layer)}
    assert len(rows) == sum(sizes)
    with pytest.raises(PySparkException):
        spark.read.format("packed_graph").option("path", path).option("tag", "other").load().collect()
    with pytest.raises(ValueError):
        P.from_bytes(b"no graph")
