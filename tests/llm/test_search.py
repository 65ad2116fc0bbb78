import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.llm import hamming_topk, hilbert_ann

ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[100:140] = x[100] + 0.001 * rng.standard_normal((40, 8))  # near copies
    x[200:230] = x[200]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(ODD)] + [(2000, [1.0, 2.0]), (2050, [2.0, 4.1]), (None, x[0].tolist()), (7, x[7].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "vector": F.lit(1)}), x


@pytest.mark.parametrize("most_asked", [hilbert_ann.ASKED, 1])
def test_neighbours(spark, vectors, most_asked):
    df, x = vectors
    found: dict = {}
    for r in hilbert_ann.search(df, df.where("vec_id % 50 = 0 OR vec_id = 7"), block=64, most_asked=most_asked).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = 0
    queries = [*range(0, 600, 50), 7]
    for q in queries:
        got = sorted(found[q])
        c = np.round(u @ u[q], 14)
        c[q] = -2
        want = np.lexsort((np.arange(len(c)), -c))[:5]
        hit += len({*want.tolist()} & {i for _, i, _ in got})
        assert [k for k, _, _ in got] == [1, 2, 3, 4, 5] and all(abs(s - u[i] @ u[q]) < 1e-12 for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
    assert hit >= 0.9 * 5 * len(queries)
    assert [i for _, i, _ in sorted(found[200])] == [201, 202, 203, 204, 205]  # copies tie: smaller ids first
    assert found[2000] == [(1, 2050, pytest.approx(0.99994, abs=1e-4))] and set(found) == {*queries, 2000, 2050}


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert hilbert_ann.search(df, df).collect() == [] == hilbert_ann.search(df.where("false"), df).collect()


@given(st.integers(1, 4), st.integers(1, 3))
@settings(max_examples=12, deadline=None)
def test_curve(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = hilbert_ann.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(codes, q, k):
    d = [(bin((c ^ codes[q]) & (1 << 64) - 1).count("1"), i) for i, c in codes.items() if i != q]
    return sorted(d)[:k]


@pytest.mark.parametrize("n,bits,k", [(400, 64, 10), (3, 64, 10), (300, 6, 5), (1, 64, 3)])
def test_exact_search(spark, monkeypatch, n, bits, k):
    monkeypatch.setattr(hamming_topk, "ROWS", 150)
    monkeypatch.setattr(hamming_topk, "LEAST_QUERIES", 16)
    rng = np.random.default_rng(n)
    codes = {i: int(c) for i, c in enumerate(rng.integers(-(2**62), 2**62, n) if bits == 64 else rng.integers(0, 1 << bits, n))}
    df = spark.createDataFrame([*codes.items(), (None, 1), (5000, None), *list(codes.items())[:2]], "id long, code long").withColumn("asks", F.lit(1))
    got: dict = {}
    for r in hamming_topk.search(df, df.where("id % 20 = 0"), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    for q in range(0, n, 20):
        assert [x[1:] for x in sorted(got.get(q, []))] == brute(codes, q, k)
    assert set(got) <= set(range(0, n, 20))


def test_sign_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5],), (None,), ([],), ([0.1] * 64,), ([0.1] * 65,)], "v array<float>")
    assert [r[0] for r in df.select(hamming_topk.sign_code(F.col("v"))).collect()] == [5, None, None, -1, None]
