"""Registered model queries (M1-M8, Q7).

A fitted model has no SQL form, so these queries return what must hold of it
row by row (split membership, ranges, tiers that follow from the scores, sums
over the node table, supports), which SQL states from the tables; tests compare
the models with brute force.  The score
normalisation (M6, M7) is also registered over the stand-in anomaly column
so its arithmetic gets an exact SQL check.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from txsentry.operators import evaluate as Q
from txsentry.operators import iforest as IF
from txsentry.operators.features import FeatureEncoder
from txsentry.operators import models as M
from txsentry.operators.scratch import stored
from txsentry.plans import scoring as P
from txsentry.plans.catalog import query
from txsentry.plans.oracle import sround, with_views
from txsentry.plans.q_prepare import _KEY_SQL
from txsentry.plans.q_reasons import _RULES_SQL
from txsentry.schema import FEATURE_COLUMNS
from txsentry.session import scratch_path
from txsentry.sources import files as S
from txsentry.sources.tables import scored, transactions


_TEST_SQL = f"""
parts AS (
  SELECT transaction_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY {_KEY_SQL}, transaction_id)
         <= ceil(0.2 * count(*) OVER (PARTITION BY is_fraud)) AS is_test
  FROM transactions)"""
MIN_AUC = 0.9       # of the fitted classifiers on the test rows


def _split_features(spark, sf_dir):
    """Encoder fitted on the training rows, the split (kept while it is used) and its training rows."""
    parts = P.split(transactions(spark, sf_dir)).persist()
    train_rows = parts.filter(F.col("is_test") == 0)
    model = FeatureEncoder(keepCols=["is_fraud", "is_test"]).fit(train_rows)
    return model, parts, train_rows


def _in_range(c: str):
    """0 <= c <= 1 as 1 or 0; a null or NaN score counts as 0."""
    return F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1), F.lit(False)).cast("int")


def _tested(spark, sf_dir, fit):
    """Test rows with their probability's range, and whether the ranking of the whole test set reaches MIN_AUC."""
    enc, parts, train_rows = _split_features(spark, sf_dir)
    clf = fit(enc.transform(train_rows))
    pred = M.fraud_probability(clf, enc.transform(parts.filter(F.col("is_test") == 1)))
    pred = stored(pred.select("transaction_id", "is_fraud", "fraud_probability"), "tested")     # scored once, read twice
    parts.unpersist()
    auc = Q.roc_auc(pred).first()["auc"]
    return pred.select("transaction_id", "is_fraud", _in_range("fraud_probability").alias("in_range"),
                       F.lit(int(auc >= MIN_AUC)).alias("ranks_well"))


_TESTED_SQL = with_views("SELECT transaction_id, is_fraud, 1 AS in_range, 1 AS ranks_well FROM parts WHERE is_test", _TEST_SQL)


@query("train_gbt", _TESTED_SQL)
def q_train_gbt(spark, sf_dir):
    return _tested(spark, sf_dir, M.train_gbt)


@query("train_rf", _TESTED_SQL)
def q_train_rf(spark, sf_dir):
    return _tested(spark, sf_dir, M.train_rf)


@query("fraud_probability", with_views("SELECT transaction_id, CAST(is_test AS INT) AS is_test, 1 AS in_range FROM parts", _TEST_SQL))
def q_fraud_probability(spark, sf_dir):
    """Every row scored, training and test rows alike."""
    enc, parts, train_rows = _split_features(spark, sf_dir)
    clf = M.train_gbt(enc.transform(train_rows))
    pred = stored(M.fraud_probability(clf, enc.transform(parts)).select("transaction_id", "is_test", "fraud_probability"), "probabilities")
    parts.unpersist()       # after its last use: the split is not made again
    return pred.select("transaction_id", "is_test", _in_range("fraud_probability").alias("in_range"))


@query("train_iforest", with_views(f"""
SELECT CAST(t.tree AS INT) AS tree, 1 AS roots, least(n, {IF.MAX_SAMPLES}) AS rows_at_root, least(n, {IF.MAX_SAMPLES}) AS rows_at_leaves,
       1 AS leaves_less_tests, 1 AS depth_kept
FROM range({IF.N_TREES}) t(tree), (SELECT count(*) AS n FROM parts WHERE NOT is_test) c""", _TEST_SQL))
def q_train_iforest(spark, sf_dir):
    """The forest's node table, summed by tree: its rows all reach a leaf, each
    test has two sides, and no path is longer than log2 of the sample."""
    enc, parts, train_rows = _split_features(spark, sf_dir)
    forest = IF.fit(enc.feature_columns(train_rows), FEATURE_COLUMNS)
    parts.unpersist()
    nodes = spark.createDataFrame(forest.nodes, IF.NODE_SCHEMA)
    leaf = F.col("feature") < 0
    sums = nodes.groupBy("tree").agg(
        F.count_if(F.col("node") == 0).cast("int").alias("roots"), F.sum(F.when(F.col("node") == 0, F.col("size"))).alias("rows_at_root"),
        F.sum(F.when(leaf, F.col("size"))).alias("rows_at_leaves"), (F.count_if(leaf) - F.count_if(~leaf)).cast("int").alias("leaves_less_tests"))
    kept = nodes.select("tree", F.col("node"), F.lit(0).alias("d")).filter("node = 0")
    most = math.ceil(math.log2(max(2, forest.psi)))
    tests = nodes.filter(~leaf)
    for _ in range(most):       # one level of all trees at a time
        kept = (kept.join(tests.select("tree", "node", "left", "right"), ["tree", "node"])
                .select("tree", F.explode(F.array("left", "right")).alias("node"), (F.col("d") + 1).alias("d")))
    deeper = kept.join(tests.select("tree", "node"), ["tree", "node"]).select("tree").distinct().withColumn("deep", F.lit(1))
    return (sums.join(deeper, "tree", "left")
            .select("tree", "roots", "rows_at_root", "rows_at_leaves", "leaves_less_tests", F.col("deep").isNull().cast("int").alias("depth_kept")))


@query("iforest_score", with_views("SELECT transaction_id, 1 AS in_range, 1 AS within_bounds FROM transactions"))
def q_iforest_score(spark, sf_dir):
    """Raw scores of every row: in (-1, 0), and training rows within the learned bounds."""
    enc, parts, train_rows = _split_features(spark, sf_dir)
    forest = IF.fit(enc.feature_columns(train_rows), FEATURE_COLUMNS)
    parts.unpersist()
    raw = enc.feature_columns(parts).select("transaction_id", "is_test", forest.raw_score(spark).alias("raw"))
    inside = (F.col("is_test") == 1) | ((F.col("raw") >= forest.score_min) & (F.col("raw") <= forest.score_max))
    return raw.select("transaction_id", F.coalesce((F.col("raw") > -1) & (F.col("raw") < 0), F.lit(False)).cast("int").alias("in_range"),
                      F.coalesce(inside, F.lit(False)).cast("int").alias("within_bounds"))


_BOUNDS = f"""
train_scores AS (
  SELECT anomaly_score FROM (
    SELECT anomaly_score, row_number() OVER (PARTITION BY is_fraud ORDER BY {_KEY_SQL},
             transaction_id) <= ceil(0.2 * count(*) OVER (PARTITION BY is_fraud)) AS is_test
    FROM scored) s WHERE NOT is_test),
bounds AS (SELECT min(anomaly_score) AS score_min, max(anomaly_score) AS score_max
           FROM train_scores)"""


def _stand_in_bounds(spark, sf_dir):
    parts = P.split(scored(spark, sf_dir))
    b = IF.score_bounds(parts.filter(F.col("is_test") == 0), "anomaly_score")
    return parts, b


@query("anomaly_bounds", with_views("SELECT score_min, score_max FROM bounds", _BOUNDS,
                                    views=("scored",)))
def q_anomaly_bounds(spark, sf_dir):
    return _stand_in_bounds(spark, sf_dir)[1]


@query("anomaly_score", with_views(f"""
SELECT transaction_id, {sround('''CASE WHEN score_max = score_min THEN 0.0
  ELSE least(1.0, greatest(0.0, 1.0 - (anomaly_score - score_min) / (score_max - score_min))) END''',
                                   6)} AS anomaly
FROM scored, bounds""", _BOUNDS, views=("scored",)))
def q_anomaly_score(spark, sf_dir):
    parts, b = _stand_in_bounds(spark, sf_dir)
    bounds = b.first()  # one row: the fitted bounds become literals, as in a model
    return parts.select("transaction_id", F.round(IF.normalized_anomaly(
        F.col("anomaly_score"), bounds["score_min"], bounds["score_max"]), 6).alias("anomaly"))


# A prediction's tier and decision must follow from its scores: 0.6 p + 0.4 a
# against the bands, where the scores are rounded to 4 digits.
_TIER = """
CASE WHEN abs(s - 0.2) < 0.0002 OR abs(s - 0.5) < 0.0002 OR abs(s - 0.75) < 0.0002 THEN risk_level
     WHEN s < 0.2 THEN 'low' WHEN s < 0.5 THEN 'medium' WHEN s < 0.75 THEN 'high' ELSE 'critical' END = risk_level
AND CASE risk_level WHEN 'low' THEN 'ALLOW' WHEN 'medium' THEN 'REVIEW' ELSE 'BLOCK' END = decision"""
CHECKED = ("transaction_id", "scores_in_range", "tier_follows", "n_reasons")
CHECKED_SQL = with_views("""
SELECT s.transaction_id, 1 AS scores_in_range, 1 AS tier_follows, CAST(t.k AS INT) AS n_reasons
FROM scored s JOIN (SELECT transaction_id, count(*) AS k FROM top3 GROUP BY transaction_id) t USING (transaction_id)""",
                         _RULES_SQL, views=("scored",))


def checked(pred):
    """Per prediction: scores in range, tier and decision in line with them, number of reasons."""
    both = F.least(_in_range("fraud_probability"), _in_range("anomaly_score"))
    return (pred.withColumn("s", F.expr("0.6 * fraud_probability + 0.4 * anomaly_score"))
            .select("transaction_id", both.alias("scores_in_range"),
                    F.coalesce(F.expr(_TIER), F.lit(False)).cast("int").alias("tier_follows"), F.size("top_reasons").alias("n_reasons")))


@query("score_transactions", CHECKED_SQL)
def q_score_transactions(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    scorer, parts = P.train(spark, tx)
    parts.unpersist()
    return checked(P.score(scorer, tx))


@query("training_summary", with_views(f"""
SELECT '{P.MODEL_VERSION}' AS model_version, count(*) AS dataset_rows, {sround('avg(is_fraud)', 4)} AS fraud_ratio,
  'GBTClassifier' AS supervised_algorithm, 1 AS ranks_well, 1 AS metrics_in_range,
  count(*) FILTER (WHERE is_test) AS n_decisions, count(*) FILTER (WHERE is_test AND is_fraud = 1) AS fraud_support,
  count(*) FILTER (WHERE is_test AND is_fraud = 0) AS normal_support, 12 AS n_features
FROM parts""", _TEST_SQL))
def q_training_summary(spark, sf_dir):
    out = scratch_path(spark, "training")
    meta = P.training_summary(spark, transactions(spark, sf_dir), out + "/models",
                              dataset_path=sf_dir)
    back = S.write_metadata(spark, meta, out + "/metadata.json")
    ranges = [f"metrics.{m} BETWEEN 0 AND 1" for m in ("supervised_f1", "anomaly_test_min", "anomaly_test_max")]
    report = "classification_report.fraud"
    return back.select("model_version", "dataset_rows", "fraud_ratio", F.col("algorithms.supervised").alias("supervised_algorithm"),
                       (F.col("metrics.supervised_auc") >= MIN_AUC).cast("int").alias("ranks_well"),
                       F.expr(" AND ".join([*ranges, f"{report}.precision BETWEEN 0 AND 1", f"{report}.recall BETWEEN 0 AND 1"]))
                       .cast("int").alias("metrics_in_range"),
                       F.expr("decisions.ALLOW + decisions.REVIEW + decisions.BLOCK").alias("n_decisions"),
                       F.col(f"{report}.support").alias("fraud_support"),
                       F.col("classification_report.normal.support").alias("normal_support"),
                       F.size("feature_names").alias("n_features"))
