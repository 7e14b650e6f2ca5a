"""Bit-vector forest scoring and the bounded sample of labelled rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txsentry.operators import evaluate as Q
from txsentry.operators import iforest as IF
from txsentry.operators import models as M
from txsentry.operators.features import FeatureEncoder
from txsentry.plans import scoring as P


def grown(rng, n_trees, psi, x):
    rows = []
    for t in range(n_trees):
        f, thr, left, right, size = IF._grow(x[rng.choice(len(x), psi)], np.random.default_rng([1, t]), 8)
        rows.append(pd.DataFrame({"tree": t, "node": range(len(f)), "feature": f, "threshold": thr, "left": left, "right": right, "size": size}))
    return pd.concat(rows)


def walked(nodes, x):
    """Path lengths by following every tree node by node."""
    total = np.zeros(len(x))
    for _, d in nodes.groupby("tree"):
        f, thr, left, right, size = (d[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size"))
        for i, row in enumerate(x):
            k = depth = 0
            while f[k] >= 0:
                k, depth = (left[k] if row[f[k]] < thr[k] else right[k]), depth + 1
            total[i] += depth + IF.c_factor([size[k]])[0]
    return total


@pytest.mark.parametrize("n_trees,psi", [(1, 1), (3, 2), (70, 20), (5, 256)])
def test_bit_vectors_find_the_leaves_of_the_trees(n_trees, psi):
    rng = np.random.default_rng(psi)
    x = np.column_stack([rng.lognormal(0, 1, 600), rng.integers(0, 2, 600), rng.integers(0, 9, 600), np.zeros(600)]).astype(float)
    nodes = grown(rng, n_trees, psi, x)
    probe = np.vstack((x[:40], [[np.nan, 1, 2, 0], [np.inf, -np.inf, 0, 0], [0, 0, 0, np.nan]],
                       np.column_stack([nodes["threshold"].to_numpy()[:20]] * 4)))     # values at thresholds themselves
    bits = IF.ForestBits(nodes, 4)
    bits.ROWS = 17
    assert np.abs(bits.path_lengths(probe) - walked(nodes, probe)).max() < 1e-9 * max(1, n_trees)


def labelled(spark, n0, n1, extra="cast(id as string)"):
    return (spark.range(n0 + n1).withColumn("is_fraud", (F.col("id") < n1).cast("int"))
            .withColumn("transaction_id", F.expr(extra)).withColumn("features", F.col("id") % 7))


def test_bounded_sample_is_seeded_weighted_and_exact(spark):
    df = labelled(spark, 5000, 300)
    got = M.bounded_sample(df, max_rows=400)
    one = got.groupBy("is_fraud").agg(F.count("*").alias("n"), F.sum("sample_weight").alias("w")).collect()
    assert {(r.is_fraud, r.n) for r in one} == {(0, 400), (1, 300)}
    assert {r.is_fraud: round(r.w, 6) for r in one} == {0: 5000, 1: 300}
    ids = lambda d: sorted(r.transaction_id for r in d.collect())
    assert ids(got) == ids(M.bounded_sample(df.repartition(7), max_rows=400)) != ids(M.bounded_sample(df, max_rows=400, seed=1))
    whole = M.bounded_sample(df, max_rows=5000)
    assert whole.count() == 5300 and whole.agg(F.max("sample_weight")).first()[0] == 1.0


def test_bounded_sample_with_one_id_and_odd_labels(spark):
    df = labelled(spark, 3000, 50, "'same'").withColumn("features", F.lit(1))       # all rows alike
    df = df.unionByName(df.limit(20).withColumn("is_fraud", F.lit(None).cast("int"))).unionByName(df.limit(5).withColumn("is_fraud", F.lit(7)))
    got = {r.is_fraud: r["count"] for r in M.bounded_sample(df, max_rows=100).groupBy("is_fraud").count().collect()}
    assert got == {0: 100, 1: 50}
    assert M.bounded_sample(df.limit(0), max_rows=100).count() == 0


def test_fit_on_the_sample_ranks_like_the_full_fit(spark, tx_mid):
    parts = P.split(tx_mid).persist()
    train = parts.filter("is_test = 0")
    enc = FeatureEncoder(keepCols=["is_fraud", "is_test"]).fit(train)
    test = enc.transform(parts.filter("is_test = 1"))
    auc = {}
    for rows in (M.MAX_CLASS_ROWS, 1500):
        model = M.train_gbt(enc.transform(train), max_iter=12, max_rows=rows)
        auc[rows] = Q.roc_auc(M.fraud_probability(model, test)).first()["auc"]
    parts.unpersist()
    assert auc[M.MAX_CLASS_ROWS] > 0.95 and abs(auc[M.MAX_CLASS_ROWS] - auc[1500]) < 0.03


@pytest.mark.parametrize("max_rows,tasks", [(400, 7), (5000, 53)])
def test_the_fitted_sample_is_dealt_evenly(spark, monkeypatch, max_rows, tasks):
    monkeypatch.setattr(M, "ROWS_PER_TASK", 100)
    data = M._weighted(labelled(spark, 5000, 300).repartition(1), "is_fraud", "scale", max_rows, 42, "features").persist()
    sizes = data.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    data.unpersist()
    assert len(sizes) == tasks and sum(sizes) == min(5000, max_rows) + 300 and max(sizes) - min(sizes) <= 2 * 4


@pytest.mark.parametrize("name", ["evaluate", "tested", "all"])
def test_rows_are_scored_once(spark, monkeypatch, name):
    from txsentry.plans import q_models
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(p):
        seen.add(1)
        return p

    n = 60
    df = labelled(spark, 50, 10).withColumn("is_test", F.lit(1))
    given = df.withColumn("fraud_probability", counted(0.2 + 0.6 * F.col("is_fraud") + F.col("id") / 1000))
    if name == "evaluate":
        whole = given.withColumns({"anomaly_score": F.col("fraud_probability"), "decision": F.lit("ALLOW")})
        monkeypatch.setattr(P, "assessed", lambda scorer, test: whole)
        got = P.evaluate(None, df)
        assert got["supervised_auc"] == 1.0 and got["decisions"]["ALLOW"] == n and got["report"]["fraud"]["support"] == 10
    else:
        class Encoder:
            def transform(self, df):
                return df
        monkeypatch.setattr(q_models, "_split_features", lambda spark, sf_dir: (Encoder(), df.persist(), df))
        monkeypatch.setattr(M, "train_gbt", lambda train: None)
        monkeypatch.setattr(M, "fraud_probability", lambda model, rows: given)
        got = q_models.q_fraud_probability(spark, "") if name == "all" else q_models._tested(spark, "", M.train_gbt)
        assert got.count() == n and got.filter("in_range = 1").count() == n
    assert seen.value == n
