"""Registered risk-tiering queries (R1-R7) over the stand-in scored feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from txsentry.functions import risk as R
from txsentry.operators import risk as ops
from txsentry.plans.catalog import query
from txsentry.plans.oracle import with_views
from txsentry.schema import RiskThresholds
from txsentry.sources.tables import scored

_LEVEL_SQL = """CASE WHEN s <= {lo} THEN 'low' WHEN s <= {me} THEN 'medium'
            WHEN s <= {hi} THEN 'high' ELSE 'critical' END"""
_DECISION_SQL = """CASE {lv} WHEN 'low' THEN 'ALLOW' WHEN 'medium' THEN 'REVIEW' ELSE 'BLOCK' END"""


def _assess_sql(lo=0.2, me=0.5, hi=0.75, alpha=0.6, beta=0.4) -> str:
    lv = _LEVEL_SQL.format(lo=lo, me=me, hi=hi)
    return with_views(f"""
SELECT transaction_id, round(s, 6) AS combined_score, {lv} AS risk_level,
       {_DECISION_SQL.format(lv=lv)} AS decision
FROM (SELECT transaction_id,
        least(1.0, greatest(0.0, {alpha} * fraud_probability + {beta} * anomaly_score)) AS s
      FROM scored) x""", views=("scored",))


@query("combined_score", with_views("""
SELECT transaction_id,
  round(least(1.0, greatest(0.0, 0.6 * fraud_probability + 0.4 * anomaly_score)), 6) AS combined_score
FROM scored""", views=("scored",)))
def q_combined_score(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "transaction_id",
        F.round(R.combined_score("fraud_probability", "anomaly_score"), 6).alias("combined_score"))


@query("risk_level", with_views(f"""
SELECT risk_level, count(*) AS n FROM (
  SELECT {_LEVEL_SQL.format(lo=0.2, me=0.5, hi=0.75)} AS risk_level
  FROM (SELECT least(1.0, greatest(0.0, 0.6 * fraud_probability + 0.4 * anomaly_score)) AS s
        FROM scored) a) b
GROUP BY risk_level""", views=("scored",)))
def q_risk_level(spark, sf_dir):
    return (ops.assess(scored(spark, sf_dir))
            .groupBy("risk_level").agg(F.count(F.lit(1)).alias("n")))


@query("decision", _assess_sql())
def q_decision(spark, sf_dir):
    return ops.assess(scored(spark, sf_dir)).select(
        "transaction_id", "combined_score", "risk_level", "decision")


@query("score_rounding", with_views("""
SELECT transaction_id, round(round(fraud_probability, 6), 4) AS fraud_probability,
       round(round(anomaly_score, 6), 4) AS anomaly_score
FROM scored""", views=("scored",)))
def q_score_rounding(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "transaction_id", R.rounded("fraud_probability").alias("fraud_probability"),
        R.rounded("anomaly_score").alias("anomaly_score"))


@query("custom_thresholds", _assess_sql(0.1, 0.3, 0.6, 0.5, 0.5))
def q_custom_thresholds(spark, sf_dir):
    t = RiskThresholds(low_max=0.1, medium_max=0.3, high_max=0.6, alpha=0.5, beta=0.5)
    return ops.assess(scored(spark, sf_dir), t).select(
        "transaction_id", "combined_score", "risk_level", "decision")


@query("decision_counts", with_views(f"""
SELECT d.decision, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT 'ALLOW' AS decision UNION ALL SELECT 'REVIEW' UNION ALL SELECT 'BLOCK') d
LEFT JOIN (
  SELECT decision, count(*) AS n FROM (
    SELECT {_DECISION_SQL.format(lv=_LEVEL_SQL.format(lo=0.2, me=0.5, hi=0.75))} AS decision
    FROM (SELECT least(1.0, greatest(0.0, 0.6 * fraud_probability + 0.4 * anomaly_score)) AS s
          FROM scored) a) b
  GROUP BY decision) c ON c.decision = d.decision""", views=("scored",)))
def q_decision_counts(spark, sf_dir):
    return ops.decision_counts(ops.assess(scored(spark, sf_dir)))


@query("binary_decision", with_views("""
SELECT transaction_id,
  CASE WHEN 0.7 * fraud_probability + 0.3 * anomaly_score > 0.5 THEN 'BLOCK' ELSE 'ALLOW' END AS decision
FROM scored""", views=("scored",)))
def q_binary_decision(spark, sf_dir):
    return ops.binary_decisions(scored(spark, sf_dir), 0.7, 0.3, 0.5).select(
        "transaction_id", "decision")
