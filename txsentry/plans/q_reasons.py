"""Registered explanation queries (X1-X9) and the prediction contract check."""

from __future__ import annotations

from pyspark.sql import functions as F

from txsentry.functions import reasons as X
from txsentry.operators import reasons as ops
from txsentry.operators import risk as risk_ops
from txsentry.operators import validate as val_ops
from txsentry.plans.catalog import query
from txsentry.plans.oracle import sround, with_views
from txsentry.sources.tables import scored

_NIGHT = "(hour(timestamp) >= 22 OR hour(timestamp) <= 5)"
_RULES_SQL = f"""
rules AS (
  SELECT transaction_id, 1 AS rule, 'high_amount' AS feature,
    CAST(CASE WHEN amount > 10000 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS contribution,
    'increases_risk' AS direction
  FROM scored WHERE amount > 5000
  UNION ALL
  SELECT transaction_id, 2,
    CASE WHEN {_NIGHT} THEN 'night_transaction' ELSE 'daytime_transaction' END,
    CAST(CASE WHEN {_NIGHT} THEN 0.3 ELSE 0.1 END AS DOUBLE),
    CASE WHEN {_NIGHT} THEN 'increases_risk' ELSE 'decreases_risk' END
  FROM scored WHERE timestamp IS NOT NULL
  UNION ALL
  SELECT transaction_id, 3,
    CASE WHEN coalesce(is_international, false) THEN 'international_transaction'
         ELSE 'domestic_transaction' END,
    CAST(CASE WHEN coalesce(is_international, false) THEN 0.2 ELSE 0.1 END AS DOUBLE),
    CASE WHEN coalesce(is_international, false) THEN 'increases_risk' ELSE 'decreases_risk' END
  FROM scored
  UNION ALL
  SELECT transaction_id, 4, 'card_not_present', CAST(0.15 AS DOUBLE), 'increases_risk'
  FROM scored WHERE NOT coalesce(card_present, true)
  UNION ALL
  SELECT transaction_id, 5, 'unusual_device', CAST(0.1 AS DOUBLE), 'increases_risk'
  FROM scored WHERE lower(coalesce(device_type, 'unknown')) = 'unknown'
),
ranked AS (
  SELECT transaction_id, CAST(row_number() OVER (PARTITION BY transaction_id
           ORDER BY contribution DESC, rule) AS INT) AS rank, feature, contribution, direction
  FROM rules
),
top3 AS (SELECT * FROM ranked WHERE rank <= 3)"""


def _sql(body: str) -> str:
    return with_views(body, _RULES_SQL, views=("scored",))


def _rule_query(key: str, rule_no: int, rule_fn):
    @query(key, _sql(f"""SELECT transaction_id, feature, contribution, direction
FROM rules WHERE rule = {rule_no}"""))
    def q(spark, sf_dir):
        r = rule_fn()
        return (scored(spark, sf_dir).select("transaction_id", r.alias("r"))
                .filter(F.col("r").isNotNull())
                .select("transaction_id", "r.feature", "r.contribution", "r.direction"))
    q.__name__ = f"q_{key}"
    return q


_rule_query("reason_amount", 1, lambda: X.reason_amount(F.col("amount")))
_rule_query("reason_time", 2, lambda: X.reason_time(F.col("timestamp")))
_rule_query("reason_geo", 3, lambda: X.reason_geo(F.col("is_international")))
_rule_query("reason_card", 4, lambda: X.reason_card(F.col("card_present")))
_rule_query("reason_device", 5, lambda: X.reason_device(F.col("device_type")))


def _explained(spark, sf_dir):
    return ops.with_top_reasons(scored(spark, sf_dir))


@query("top_reasons", _sql("SELECT * FROM top3"))
def q_top_reasons(spark, sf_dir):
    return ops.reason_rows(_explained(spark, sf_dir))


@query("reason_frequency", _sql("""
SELECT feature, direction, count(*) AS n, round(avg(contribution), 6) AS mean_contribution
FROM top3 GROUP BY feature, direction"""))
def q_reason_frequency(spark, sf_dir):
    return ops.reason_frequency(_explained(spark, sf_dir))


@query("reason_display", _sql("""
SELECT transaction_id, rank,
  array_to_string(list_transform(string_split(feature, '_'),
                                 lambda w: upper(w[1]) || w[2:]), ' ') AS label,
  CAST(round(contribution * 100) AS INT) AS percent,
  CASE WHEN round(contribution * 100) > 40 THEN 'high'
       WHEN round(contribution * 100) > 20 THEN 'medium' ELSE 'low' END AS band
FROM top3"""))
def q_reason_display(spark, sf_dir):
    rows = ops.reason_display(ops.reason_rows(_explained(spark, sf_dir)))
    return rows.select("transaction_id", "rank", "label", "percent", "band")


@query("probability_band", with_views(f"""
SELECT transaction_id, {sround("fraud_probability * 100", 1)} AS probability_pct,
  CASE WHEN fraud_probability > 0.7 THEN 'high' WHEN fraud_probability > 0.3 THEN 'medium'
       ELSE 'low' END AS probability_band
FROM scored""", views=("scored",)))
def q_probability_band(spark, sf_dir):
    return ops.probability_display(scored(spark, sf_dir)).select(
        "transaction_id", "probability_pct", "probability_band")


@query("prediction_check", _sql("""
SELECT 'fraud_probability:out_of_range' AS rule,
  CAST(count(*) FILTER (WHERE fraud_probability IS NULL OR fraud_probability < 0
                         OR fraud_probability > 1) AS BIGINT) AS n FROM scored
UNION ALL
SELECT 'anomaly_score:out_of_range',
  CAST(count(*) FILTER (WHERE anomaly_score IS NULL OR anomaly_score < 0
                         OR anomaly_score > 1) AS BIGINT) FROM scored
UNION ALL
SELECT 'risk_level:invalid', CAST(count(*) FILTER (WHERE lvl NOT IN ('low','medium','high','critical'))
  AS BIGINT) FROM (SELECT CASE WHEN s <= 0.2 THEN 'low' WHEN s <= 0.5 THEN 'medium'
                   WHEN s <= 0.75 THEN 'high' ELSE 'critical' END AS lvl
                   FROM (SELECT least(1.0, greatest(0.0, 0.6 * fraud_probability
                         + 0.4 * anomaly_score)) AS s FROM scored) a) b
UNION ALL
SELECT 'decision:invalid', CAST(0 AS BIGINT)
UNION ALL
SELECT 'top_reasons:too_many', CAST(count(*) FILTER (WHERE k > 5) AS BIGINT)
  FROM (SELECT transaction_id, count(*) AS k FROM top3 GROUP BY transaction_id) c
UNION ALL
SELECT 'top_reasons:bad_direction', CAST(count(*) FILTER (
  WHERE direction NOT IN ('increases_risk', 'decreases_risk')) AS BIGINT) FROM top3"""))
def q_prediction_check(spark, sf_dir):
    pred = ops.with_top_reasons(risk_ops.assess(scored(spark, sf_dir)))
    return val_ops.prediction_summary(pred)
