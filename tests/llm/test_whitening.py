"""op11: the qd solver against numpy, whitening against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sf_paths import SF_MID
from txsentry.llm import whitening
from txsentry.llm.bidiagonal import bidiagonalise, dqds, right_vectors
from txsentry.llm.queries import op11_qd_whitening

RNG = np.random.default_rng(3)


def orthogonal(n):
    return np.linalg.qr(RNG.standard_normal((n, n)))[0]


CASES = {
    "random": lambda: RNG.standard_normal((300, 40)),
    "one": lambda: np.array([[3.0]]),
    "graded": lambda: RNG.standard_normal((200, 30)) * np.logspace(0, -7, 30),
    "graded up": lambda: RNG.standard_normal((200, 30)) * np.logspace(-7, 0, 30),
    "identity": lambda: np.eye(20),
    "equal": lambda: 3 * orthogonal(30),
    "two values": lambda: orthogonal(64) @ np.diag([2.0] * 32 + [1.0] * 32) @ orthogonal(64),
    "near equal": lambda: orthogonal(40) @ np.diag(1 + 1e-12 * RNG.standard_normal(40)) @ orthogonal(40),
    "repeated columns": lambda: np.hstack([RNG.standard_normal((100, 10))] * 2),
    "zero columns": lambda: np.hstack([RNG.standard_normal((100, 10)), np.zeros((100, 5))]),
    "pairs": lambda: np.diag(np.abs(np.arange(41) - 20.0) + 0.1) + np.diag(np.ones(40), 1),
}


@pytest.mark.parametrize("name", CASES)
def test_solver(name):
    a = CASES[name]()
    r = np.linalg.qr(a, mode="r") if len(a) > a.shape[1] else a
    values, v = right_vectors(r)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-11
    assert np.abs(a.T @ (a @ v.T) - v.T * values).max() < 1e-12 * want[0]


def test_small_values_keep_their_digits():
    # Products and sums of the values are those of the matrix, over forty decades.
    q, e = [10.0 ** -k for k in range(0, 40, 2)], [10.0 ** (-k - 3) for k in range(0, 38, 2)]
    got = dqds(q, e)
    assert got == sorted(got, reverse=True) and got[-1] < 1e-37
    assert np.isclose(np.log(got).sum(), np.log(q).sum(), rtol=1e-14)
    assert np.isclose(sum(got), sum(q) + sum(e), rtol=1e-14)
    # the inverse matrix has the inverse values: its trace holds the small ones
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1)
    inverse = np.linalg.inv(b / np.sqrt(q)[:, None]) / np.sqrt(q)[None, :]
    assert np.isclose(sum(1 / x for x in got), (inverse ** 2).sum(), rtol=1e-12)


def test_bidiagonal_form():
    a = RNG.standard_normal((12, 12))
    d, e, v = bidiagonalise(a)
    b = np.diag(d) + np.diag(e, 1)
    assert np.allclose(v.T @ (a.T @ a) @ v, b.T @ b)


def brute(vectors, k=32):
    """{id: (deviation, |whitened|)}, explained shares, n: from the covariance itself."""
    x = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000 for i, v in vectors.items()}
    m = np.array(list(x.values()), np.int64)
    n, s = len(m), m.sum(axis=0)
    c = (m * n - s) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    dev = {i: int(((v * n - s).astype(object) ** 2).sum()) for i, v in x.items()}
    return dev, dict(zip(x, np.abs(c @ w / np.sqrt(e)))), e / np.trace(c.T @ c / n), n


def test_query_equals_brute_force(spark):
    rows = op11_qd_whitening(spark, SF_MID).toPandas()
    vecs = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()}
    dev, white, share, n = brute(vecs)
    assert len(rows) == len(vecs) * 32 and set(rows.n) == {n} and rows.identity_error.nunique() == 1
    assert rows.identity_error.iloc[0] < 1e-10
    for i, part in rows.groupby("vec_id"):
        part = part.sort_values("component")
        assert list(part.component) == list(range(1, 33)) and set(part.deviation) == {dev[i]}
        assert np.allclose(np.abs(part.whitened), white[i], atol=1e-8)
        assert np.allclose(part.explained, share, rtol=1e-10)


def test_merge_tree(spark, monkeypatch):
    # many small parts and blocks, several levels, give the same directions
    table = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    vectors = whitening.whole_vectors(table)
    n, s = whitening.sums(vectors)
    one = whitening.directions(whitening.triangle(vectors.coalesce(1), n, s), n)
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    many = whitening.directions(whitening.triangle(vectors.repartition(17), n, s), n)
    assert np.allclose(one[0], many[0], rtol=1e-12) and np.isclose(one[2], many[2])
    assert np.allclose(np.abs((one[1] * many[1]).sum(axis=1)), 1, atol=1e-10)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, -1.0, 0.5]), (2, [2.0, -1.0, 0.5]), (None, [0.0, 0.25, 4.0]), (5, None), (6, []),
            (7, [1.0, None, 2.0]), (8, [nan, 1.0, 1.0]), (9, [1.0, inf, 1.0]), (10, [1.0, 2.0]), (11, [-3.0, 5.0, 1.5])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, component int, n double").repartition(4)
    got = whitening.whiten(df).toPandas()
    good = {0: rows[0][1], 1: rows[1][1], 2: rows[2][1], 3: rows[3][1], 4: rows[10][1]}
    dev, white, share, n = brute(good, 3)
    assert n == 5 and len(got) == 15 and set(got.n) == {5} and got.identity_error.iloc[0] < 1e-10
    assert got.vec_id.isna().sum() == 3 and (got.vec_id == 2).sum() == 6
    assert sorted(set(got.deviation)) == sorted(set(dev.values()))
    one = got[got.vec_id == 11].sort_values("component")
    assert np.allclose(np.abs(one.whitened), white[4], atol=1e-9) and np.allclose(one.explained, share)


def test_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    # a dimension that never varies and one that copies another are no directions
    flat = spark.range(50).select(F.col("id").alias("vec_id"), F.array(*[F.col("id").cast("float")] * 2, F.lit(7.0).cast("float")).alias("embedding"))
    got = whitening.whiten(flat).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1) and got.identity_error.iloc[0] < 1e-10


def test_large_entries(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(df).collect()
