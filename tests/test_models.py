"""Models: forest sanity, score ranges, save/load equality, training job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txsentry.operators import iforest as IF
from txsentry.plans import scoring as P
from txsentry.schema import RiskThresholds
from txsentry.session import scratch_path
from txsentry.sources import files as S


def test_iforest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(0, 1, size=(2000, 3))
    outliers = rng.normal(8, 1, size=(10, 3))
    rows = [(f"n{i}", *map(float, x)) for i, x in enumerate(normal)] + \
           [(f"o{i}", *map(float, x)) for i, x in enumerate(outliers)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double")
    model = IF.fit(df, ["a", "b", "c"], id_col="id", n_trees=50)
    scored = df.select("id", model.anomaly_score(model.raw_score(spark)).alias("s")) \
               .orderBy(F.col("s").desc()).limit(10).collect()
    assert {r.id for r in scored} == {f"o{i}" for i in range(10)}


def test_iforest_node_table_bounded(spark, tx_small):
    from txsentry.operators.features import FeatureEncoder
    from txsentry.schema import FEATURE_COLUMNS
    enc = FeatureEncoder().fit(tx_small)
    model = IF.fit(enc.feature_columns(tx_small), FEATURE_COLUMNS, n_trees=20)
    assert len(model.nodes) <= 20 * (2 * model.psi - 1)
    assert sorted(model.nodes["tree"].unique()) == list(range(20))


def test_normalised_anomaly_zero_range(spark):
    df = spark.createDataFrame([(0.3,)], "raw double")
    assert df.select(IF.normalized_anomaly(F.col("raw"), 0.3, 0.3)).first()[0] == 0.0


@pytest.fixture(scope="module")
def trained(spark, tx_small):
    return P.train(spark, tx_small, max_iter=5, forest_trees=30)


def test_scores_in_range_and_reasons_bounded(trained, tx_small):
    scorer, _ = trained
    pred = P.score(scorer, tx_small)
    agg = pred.agg(F.min("fraud_probability"), F.max("fraud_probability"),
                   F.min("anomaly_score"), F.max("anomaly_score"),
                   F.max(F.size("top_reasons")), F.count(F.lit(1))).first()
    assert 0 <= agg[0] <= agg[1] <= 1 and 0 <= agg[2] <= agg[3] <= 1
    assert agg[4] <= 3 and agg[5] == tx_small.count()


def test_fraud_scores_higher_than_normal(trained, tx_small):
    scorer, _ = trained
    pred = P.score(scorer, tx_small, keep=("is_fraud",))
    means = {r.is_fraud: r.m for r in
             pred.groupBy("is_fraud").agg(F.avg("fraud_probability").alias("m")).collect()}
    assert means[1] > means[0]


def test_save_load_same_scores(spark, trained, tx_small):
    scorer, _ = trained
    path = scratch_path(spark, "scorer")
    scorer.save(spark, path)
    loaded = P.Scorer.load(spark, path)
    a = P.score(scorer, tx_small).select("transaction_id", "fraud_probability", "anomaly_score")
    b = P.score(loaded, tx_small).select("transaction_id", "fraud_probability", "anomaly_score")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_training_summary_metadata(spark, tx_small):
    out = scratch_path(spark, "train")
    meta = P.training_summary(spark, tx_small, out + "/m", dataset_path="sf0.001",
                              max_iter=5, forest_trees=20)
    for key in ("model_version", "training_timestamp", "dataset_rows", "fraud_ratio",
                "feature_names", "algorithms", "metrics", "thresholds", "artifacts"):
        assert key in meta
    assert meta["dataset_rows"] == tx_small.count()
    assert 0.0 <= meta["metrics"]["supervised_auc"] <= 1.0
    back = S.write_metadata(spark, meta, out + "/metadata.json").first()
    assert back.dataset_rows == meta["dataset_rows"]


def test_random_forest_fallback(spark, tx_small):
    scorer, _ = P.train(spark, tx_small, algo="rf", rf_trees=10, forest_trees=10)
    assert scorer.algorithm == "RandomForestClassifier"
    assert P.score(scorer, tx_small).count() == tx_small.count()


def test_example_payloads_end_to_end(spark, tx_mid):
    """Trained on the feed, the suspicious example is blocked with p > 0.5 and
    the safe one gets p < 0.2 (its decision also depends on the forest)."""
    from test_golden import SAFE, SUSPICIOUS
    from txsentry.operators import validate as V
    from txsentry.sources.files import from_records
    scorer, _ = P.train(spark, tx_mid, max_iter=20, forest_trees=100)
    acc, rej = V.split(from_records(spark, [SAFE, SUSPICIOUS]))
    assert rej.count() == 0
    got = {r.transaction_id: r for r in P.score(scorer, acc).collect()}
    fraud, safe = got[SUSPICIOUS["transaction_id"]], got[SAFE["transaction_id"]]
    assert fraud.fraud_probability > 0.5 and fraud.decision == "BLOCK"
    assert safe.fraud_probability < 0.2


@pytest.mark.parametrize("n_rows,n_trees", [(600, 20), (20000, 10)])
def test_iforest_deterministic_and_full_samples(spark, n_rows, n_trees):
    """Small and large tables alike: every tree is grown on exactly psi rows, and
    refitting gives the same trees."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n_rows, 2))
    df = spark.createDataFrame([(f"r{i}", float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "id string, a double, b double")
    m1 = IF.fit(df, ["a", "b"], id_col="id", n_trees=n_trees)
    m2 = IF.fit(df, ["a", "b"], id_col="id", n_trees=n_trees)
    roots = m1.nodes[m1.nodes["node"] == 0]
    assert m1.psi == min(256, n_rows)
    assert (roots["size"] == m1.psi).all()
    cols = ["tree", "node", "feature", "threshold", "left", "right", "size"]
    a = m1.nodes[cols].sort_values(["tree", "node"]).reset_index(drop=True)
    b = m2.nodes[cols].sort_values(["tree", "node"]).reset_index(drop=True)
    assert a.equals(b)


@pytest.mark.parametrize("n_rows", [150, 3000, 40_000])
def test_iforest_null_and_repeated_ids(spark, n_rows):
    """Rows without an id, or sharing one, still give full trees at every size."""
    for rid in ("CAST(NULL AS string)", "CAST(id % 3 AS string)"):
        df = spark.range(n_rows).selectExpr(f"{rid} AS id", "sin(id) AS a", "pmod(id * 37, 101) / 101D AS b")
        m = IF.fit(df, ["a", "b"], id_col="id", n_trees=20)
        roots = m.nodes[m.nodes["node"] == 0]
        assert len(roots) == 20 and (roots["size"] == min(256, n_rows)).all()
        assert m.score_max > m.score_min


def test_iforest_equal_rows_count_each(spark):
    df = spark.range(900).selectExpr("'x' AS id", "CAST(id < 300 AS double) AS a")
    m = IF.fit(df, ["a"], id_col="id", n_trees=10, max_samples=600)
    assert (m.nodes[m.nodes["node"] == 0]["size"] == 600).all()


def test_iforest_empty_table_is_an_error(spark):
    with pytest.raises(ValueError):
        IF.fit(spark.range(0).selectExpr("id", "1D AS a"), ["a"], id_col="id")


def test_scorer_keeps_its_thresholds(spark, tx_small, tmp_path):
    scorer, parts = P.train(spark, tx_small, max_iter=2, forest_trees=5)
    scorer.thresholds = RiskThresholds(low_max=0.1, medium_max=0.3, high_max=0.6, alpha=0.5, beta=0.5)
    scorer.save(spark, str(tmp_path / "m"))
    assert P.Scorer.load(spark, str(tmp_path / "m")).thresholds == scorer.thresholds
    parts.unpersist()
