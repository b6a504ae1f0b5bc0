"""Whitening and top-k search against brute force, and both on odd tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import blockmax, whitening

KIND = "vec_id long, embedding array<float>"


def integers(rows, scale, offset=0):
    """(vec_id, list of ints) of the rows that take part."""
    return [(i, [math.floor(scale * float(x)) + offset for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute_top(rows, k=5, every=50):
    got, held = [], integers(rows, 256)
    for r, (q, v) in enumerate(held):
        if q is not None and q % every == 0:
            scored = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i is None, i or 0) for c, (i, w) in enumerate(held) if c != r))[:k]
            got += [(q, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(scored)]
    return sorted(map(str, got))


def check_whitening(spark, rows, kind=KIND):
    table = whitening.query(spark.createDataFrame(rows, kind)).persist()
    assert all(r["deviation"] == (int(r["deviation_exact"]) if int(r["deviation_exact"]) < 2**63 else None) for r in table.collect())
    got = table.toPandas()
    held = integers(rows, 64, 1_000_000)
    fit = sorted({tuple(v) for _, v in held})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit), n**3)) for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(16, int((e > d * np.finfo(float).eps * e[0]).sum()))
    assert len(got) == k * len(held) and (got.n == n).all() and (got.identity_error < 1e-4).all()
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(e[:k] / e.sum(), rel=1e-4)
    # rows come in the order of the table within a partition, so compare by vec_id and deviation
    exact = sorted((i if i is not None else -1, sum((n * x - t) ** 2 for x, t in zip(v, s))) for i, v in held for _ in range(k))
    assert sorted(zip(got.vec_id.fillna(-1).astype(int), map(int, got.deviation_exact))) == exact
    want = {}
    for i, v in held:
        want.setdefault(i, []).append(np.array([float(Fraction(n * x - t, n)) for x, t in zip(v, s)]) @ axes[:, :k] / np.sqrt(e[:k]))
    for i, own in got[got.vec_id.notna()].groupby("vec_id"):
        w = own.sort_values("component").whitened.to_numpy()
        if len(want[i]) == 1:
            assert np.abs(w) == pytest.approx(np.abs(want[i][0]), rel=1e-6, abs=1e-6)
    return got


def test_whitening_is_the_brute_force_one(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(150).collect()]
    check_whitening(spark, rows + rows[:40])


def test_whitened_columns_are_white(spark, sf):
    got = whitening.query(spark.read.parquet(f"{sf}/embeddings.parquet")).toPandas()
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / len(w) - np.eye(16)).max() < 1e-9


def test_whitening_of_large_entries(spark):
    """Sums beyond longs and decimals of 38 digits stay exact: limbs of all powers occur."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(0, s, 5)]) for i, s in enumerate(np.repeat([1.0, 1e6, 1e16], 40))]
    got = check_whitening(spark, rows, "vec_id long, embedding array<double>")
    assert got.deviation.isna().any()


def test_partial_sums_leave_in_time():
    import pyarrow as pa

    x = np.full((5000, 2), 1 << 19, np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.int64()))], ["x"])] * 3
    out = [r for b in whitening._partial_sums(2, 0)(iter(batches)) for r in b.to_pylist()]
    total = sum(r["v"] << (20 * r["power"]) for r in out if (r["i"], r["j"]) == (0, 1))
    assert total == 15000 << 38 and sum(r["v"] for r in out if r["j"] == -1) == 15000


def test_limbs_put_together():
    x = np.array([[0, 1, -1, 1 << 20, -(1 << 20), (1 << 20) + 1, 2**62, -(2**62), 9 * 10**18]])
    parts = whitening.limbs(x)
    assert [sum(int(p[0, c]) << (20 * k) for k, p in enumerate(parts)) for c in range(x.shape[1])] == x[0].tolist()
    assert max(np.abs(p).max() for p in parts) <= 1 << 20


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [3.0, -1.0]), (7, [0.5]), (8, []), (9, [2.5, 2.5]), (9, [2.5, 2.5])]
    got = whitening.query(spark.createDataFrame([(*r, 0, "x") for r in odd], KIND + ", component int, x string")).toPandas()
    assert got.n.eq(3).all() and len(got) == 2 * 5 and got.vec_id.isna().sum() == 2 and got.columns[:2].tolist() == ["vec_id", "component"]
    assert whitening.query(spark.createDataFrame([], KIND)).count() == 0
    assert whitening.query(spark.createDataFrame([(1, [1.0, 2.0])] * 3, KIND)).count() == 0
    assert whitening.query(spark.createDataFrame([(1, None), (2, [])], KIND)).count() == 0
    # the second entry never varies: it has no component
    flat = whitening.query(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], KIND)).toPandas()
    assert set(flat.component) == {1} and flat.explained.iloc[0] == pytest.approx(1) and flat.identity_error.iloc[0] < 1e-9


def test_top_k_is_the_brute_force_one(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows += [(7, rows[0][1])] * 30 + [(None, rows[50][1])] * 3 + [(50, rows[50][1]), (100, rows[3][1])]
    table = spark.createDataFrame(rows, KIND).repartition(3)
    assert sorted(str(tuple(r)) for r in blockmax.query(table).collect()) == brute_top(rows)


def test_top_k_over_many_blocks_and_slices(spark):
    r = np.random.default_rng(2)
    centres = r.normal(0, 1, (12, 8))
    rows = [(int(i), [float(x) for x in centres[i % 12] + r.normal(0, 0.02, 8)]) for i in range(2000)]
    rows += [(i, rows[0][1]) for i in range(2000, 2300)]  # a hot vector fills many blocks
    table = spark.createDataFrame(rows, KIND)
    assert sorted(str(tuple(x)) for x in blockmax.top_k(table, F.col("vec_id") % 50 == 0, size=13, block=16).collect()) == brute_top(rows)


def test_search_leaves_far_blocks_out():
    """On clustered vectors most blocks fall below the kth score and aren't scored."""
    r = np.random.default_rng(4)
    v = np.floor(256 * (np.repeat(np.eye(16), 64, 0) + r.normal(0, 0.01, (1024, 16))))
    found = blockmax.Found(v[::64].copy(), np.full(16, -math.inf), np.arange(16) * blockmax.BLOCK, 5)
    blocks = [(b, v[64 * b : 64 * b + 64].min(0), v[64 * b : 64 * b + 64].max(0), np.arange(64 * b, 64 * b + 64), np.zeros(64, bool), v[64 * b : 64 * b + 64]) for b in range(16)]
    assert blockmax.search(found, blocks) < 2 * 16
    scores = v @ v[::64].T
    scores[::64][np.eye(16, dtype=bool)] = -math.inf
    assert (np.sort(scores, 0)[-5:][::-1].T == found.score).all()


@pytest.mark.parametrize("size", [1.0, 1e6, 1e15])
def test_top_k_of_large_entries(spark, size):
    r = np.random.default_rng(3)
    rows = [(i * 10, [float(x) * size for x in r.normal(0, 1, 4)]) for i in range(60)]
    got = blockmax.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(str(tuple(x)) for x in got) == brute_top(rows)


def test_top_k_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0]), (None, [1.0, 0.0]), (50, None), (100, [nan, 0.0]), (150, [None, 1.0]), (200, [inf, 1.0]), (250, [1.0]), (300, [0.0, 0.0]), (3, [1.0, 0.0]), (0, [1.0, 0.0])]
    got = blockmax.query(spark.createDataFrame([(*r, 1) for r in odd], KIND + ", rank int")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_top([r for r in odd if r[1] is None or len(r[1]) == 2])
    assert blockmax.query(spark.createDataFrame([], KIND)).count() == 0
    assert blockmax.query(spark.createDataFrame([(0, [1.0])], KIND)).count() == 0
    assert blockmax.query(spark.createDataFrame([(1, [1.0]), (2, [1.0])], KIND)).count() == 0
    assert blockmax.query(spark.createDataFrame([(0, []), (50, [])], KIND)).count() == 2
