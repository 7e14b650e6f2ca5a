"""Registered evaluation queries (Q1-Q6) over the stand-in scored feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from txsentry.operators import evaluate as Q
from txsentry.plans.catalog import query
from txsentry.plans.oracle import sround, with_views
from txsentry.sources.tables import scored

_PRED = "pred AS (SELECT *, CAST(fraud_probability >= 0.5 AS INT) AS predicted FROM scored)"
_COUNTS = """
counts AS (SELECT
  CAST(count(*) FILTER (WHERE is_fraud = 1 AND predicted = 1) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE is_fraud = 0 AND predicted = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE is_fraud = 1 AND predicted = 0) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE is_fraud = 0 AND predicted = 0) AS DOUBLE) AS tn
FROM pred)"""


def _pred(spark, sf_dir):
    return Q.threshold_predict(scored(spark, sf_dir))


@query("roc_auc", with_views(f"""
SELECT {sround('sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg))', 6)} AS auc
FROM (SELECT s, pos, neg, sum(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) - neg AS neg_below
      FROM (SELECT fraud_probability AS s, CAST(sum(is_fraud) AS DOUBLE) AS pos,
                   CAST(sum(1 - is_fraud) AS DOUBLE) AS neg
            FROM scored GROUP BY fraud_probability) a) b""", views=("scored",)))
def q_roc_auc(spark, sf_dir):
    return Q.roc_auc(scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query("threshold_predict", with_views("SELECT transaction_id, predicted FROM pred", _PRED,
                                       views=("scored",)))
def q_threshold_predict(spark, sf_dir):
    return _pred(spark, sf_dir).select("transaction_id", "predicted")


@query("f1_positive", with_views(f"""
SELECT {sround('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END', 6)}
  AS f1 FROM counts""", _PRED, _COUNTS, views=("scored",)))
def q_f1_positive(spark, sf_dir):
    return Q.f1_positive(_pred(spark, sf_dir)).select(F.round("f1", 6).alias("f1"))


def _div(a, b):
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


_REPORT = f"""
m AS (SELECT {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1,
             {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0,
             tp + fn AS s1, tn + fp AS s0, tp + fp + fn + tn AS n,
             {_div('tp + tn', 'tp + fp + fn + tn')} AS acc FROM counts),
m2 AS (SELECT *, CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
              CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1 FROM m),
report AS (
  SELECT 'normal' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m2
  UNION ALL SELECT 'fraud', p1, r1, f1, s1 FROM m2
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM m2
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m2
  UNION ALL SELECT 'weighted avg', p0 * s0 / n + p1 * s1 / n, r0 * s0 / n + r1 * s1 / n,
                   f0 * s0 / n + f1 * s1 / n, n FROM m2)"""


@query("classification_report", with_views(f"""
SELECT class, {sround('precision', 6)} AS precision, {sround('recall', 6)} AS recall,
       {sround('f1', 6)} AS f1, CAST(support AS BIGINT) AS support FROM report""",
                                           _PRED, _COUNTS, _REPORT, views=("scored",)))
def q_classification_report(spark, sf_dir):
    r = Q.classification_report(_pred(spark, sf_dir))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("bigint").alias("support"))


@query("confusion_matrix", with_views("""
SELECT is_fraud AS actual, predicted, count(*) AS n FROM pred GROUP BY is_fraud, predicted""",
                                      _PRED, views=("scored",)))
def q_confusion_matrix(spark, sf_dir):
    return Q.confusion_matrix(_pred(spark, sf_dir))


@query("score_range", with_views("""
SELECT min(anomaly_score) AS score_min, max(anomaly_score) AS score_max FROM scored""",
                                 views=("scored",)))
def q_score_range(spark, sf_dir):
    return Q.score_range(scored(spark, sf_dir))
