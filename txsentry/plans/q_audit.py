"""Registered audit-log queries.

The audit rows are the stand-in predictions of the whole feed (risk tier,
decision and reasons from the scored view).  A1-A3 and A5-A7 write to a fresh
table in the session's shared work folder and read it back; reads of the newest
rows go through the log's zone manifest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from txsentry.functions import risk as R
from txsentry.operators import audit as A
from txsentry.operators import audit_log as L
from txsentry.operators import keyed_table as K
from txsentry.operators import reasons as X
from txsentry.operators import risk as risk_ops
from txsentry.operators.scratch import stored
from txsentry.plans.catalog import query
from txsentry.plans.oracle import with_views
from txsentry.plans.q_reasons import _RULES_SQL
from txsentry.session import scratch_path
from txsentry.sources.tables import scored

_S = "least(1.0, greatest(0.0, 0.6 * fraud_probability + 0.4 * anomaly_score))"
_LEVEL = (f"CASE WHEN {_S} <= 0.2 THEN 'low' WHEN {_S} <= 0.5 THEN 'medium' "
          f"WHEN {_S} <= 0.75 THEN 'high' ELSE 'critical' END")
_DECISION = (f"CASE WHEN {_S} <= 0.2 THEN 'ALLOW' WHEN {_S} <= 0.5 THEN 'REVIEW' ELSE 'BLOCK' END")
_AUDIT = f"""
audit AS (
 SELECT CAST(id AS VARCHAR) AS id, transaction_id, user_id,
   round(round(fraud_probability, 6), 4) AS fraud_probability,
   round(round(anomaly_score, 6), 4) AS anomaly_score,
   {_LEVEL} AS risk_level, {_DECISION} AS decision, created_at,
   amount, country, is_international, timestamp, {_S} AS combined
 FROM scored),
recent AS (SELECT * FROM audit ORDER BY created_at DESC, id DESC)"""
_TS = "'%Y-%m-%d %H:%M:%S'"


def _sql(body: str) -> str:
    return with_views(body, _RULES_SQL, _AUDIT, views=("scored",))


def _predictions(spark, sf_dir):
    """Response-shaped predictions: rounded scores, tier, decision, reasons."""
    p = X.with_top_reasons(risk_ops.assess(scored(spark, sf_dir)))
    return p.withColumns({"fraud_probability": R.rounded("fraud_probability"),
                          "anomaly_score": R.rounded("anomaly_score")})


def _audit(spark, sf_dir):
    return A.audit_rows(_predictions(spark, sf_dir), id_col="id")


@query("audit_append", _sql(f"""
SELECT a.id, a.transaction_id, a.user_id, a.fraud_probability, a.anomaly_score, a.risk_level,
       a.decision, strftime(a.created_at, {_TS}) AS created_at, CAST(t.k AS INT) AS n_reasons
FROM audit a JOIN (SELECT transaction_id, count(*) AS k FROM top3 GROUP BY transaction_id) t
  USING (transaction_id)"""))
def q_audit_append(spark, sf_dir):
    path = scratch_path(spark, "audit")
    A.audit_append(_audit(spark, sf_dir), path)
    back = A.read_audit(spark, path)
    return back.select("id", "transaction_id", "user_id", "fraud_probability", "anomaly_score",
                       "risk_level", "decision",
                       F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                       F.json_array_length("top_reasons").alias("n_reasons"))


def _keyed_rows(pred):
    return pred.select("transaction_id", "user_id", "amount", F.col("combined_score").alias("risk_score"), "decision",
                       F.to_json("top_reasons").alias("explanation"), F.col("created_at").alias("timestamp"))


@query("keyed_store", _sql("""
SELECT transaction_id, decision, round(combined, 6) AS risk_score, 'stored' AS outcome FROM audit
UNION ALL SELECT transaction_id, decision, round(combined, 6), 'stored before' FROM audit WHERE decision = 'BLOCK'
UNION ALL SELECT transaction_id, decision, round(combined, 6), 'repeated in batch' FROM audit WHERE decision = 'BLOCK'
UNION ALL SELECT NULL, decision, round(combined, 6), 'missing key' FROM audit WHERE decision = 'REVIEW'"""))
def q_keyed_store(spark, sf_dir):
    """The store and its quarantine after the feed, then a retry of every
    blocked transaction, twice in one batch an hour later, with the reviewed
    ones without their key; the retry itself is sent again and adds nothing."""
    rows = stored(_keyed_rows(_predictions(spark, sf_dir)), "keyed-feed")      # the retries send these rows again
    path = scratch_path(spark, "keyed")
    K.insert(rows, path, "feed", order="timestamp")
    later = rows.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR"))
    blocked = later.filter(F.col("decision") == "BLOCK")
    nameless = later.filter(F.col("decision") == "REVIEW").withColumn("transaction_id", F.lit(None).cast("string"))
    retry = blocked.unionByName(blocked).unionByName(nameless)
    for _ in range(2):
        K.insert(retry, path, "retry", order="timestamp")
    out = ["transaction_id", "decision", "risk_score"]
    return (K.read(spark, path, rows.schema).select(*out, F.lit("stored").alias("outcome"))
            .unionByName(K.quarantine(spark, path, rows.schema).select(*out, F.col("reason").alias("outcome"))))


@query("audit_recent", _sql(f"""
SELECT id, transaction_id, decision, strftime(created_at, {_TS}) AS created_at
FROM recent LIMIT 20"""))
def q_audit_recent(spark, sf_dir):
    path = scratch_path(spark, "audit-recent")
    L.append(_audit(spark, sf_dir), path, "feed")
    r = L.newest(spark, path, 20)
    return r.select("id", "transaction_id", "decision",
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("audit_parse_json", _sql("""
SELECT a.transaction_id, a.amount, a.country, CAST(a.is_international AS INT) AS is_international,
  strftime(a.timestamp, '%Y-%m-%d %H:%M:%S.%f') AS event_time,
  CAST(t.k AS INT) AS n_reasons, f.feature AS first_reason
FROM audit a
JOIN (SELECT transaction_id, count(*) AS k FROM top3 GROUP BY transaction_id) t USING (transaction_id)
JOIN (SELECT transaction_id, feature FROM top3 WHERE rank = 1) f USING (transaction_id)"""))
def q_audit_parse_json(spark, sf_dir):
    p = A.parse_json(_audit(spark, sf_dir))
    return p.select("transaction_id", F.col("payload.amount").alias("amount"),
                    F.col("payload.country").alias("country"),
                    F.col("payload.is_international").cast("int").alias("is_international"),
                    F.date_format("payload.timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
                     .alias("event_time"),
                    F.size("reasons").alias("n_reasons"),
                    F.col("reasons")[0]["feature"].alias("first_reason"))


@query("audit_stats", _sql("""
SELECT count(*) AS window_size, count(*) FILTER (WHERE decision = 'BLOCK') AS blocks,
  count(*) FILTER (WHERE decision = 'REVIEW') AS reviews,
  count(*) FILTER (WHERE decision = 'ALLOW') AS allows
FROM (SELECT * FROM recent LIMIT 100) r"""))
def q_audit_stats(spark, sf_dir):
    path = scratch_path(spark, "audit-stats")
    L.append(_audit(spark, sf_dir), path, "feed")
    return A.decision_window_stats(L.newest(spark, path, 100), 100)


@query("dashboard_stats", _sql("""
SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'ALLOW') AS allowed,
  count(*) FILTER (WHERE decision = 'REVIEW') AS review,
  count(*) FILTER (WHERE decision = 'BLOCK') AS blocked
FROM (SELECT * FROM recent LIMIT 15) r"""))
def q_dashboard_stats(spark, sf_dir):
    path = scratch_path(spark, "audit-dashboard")
    L.append(_audit(spark, sf_dir), path, "feed")
    return A.dashboard_stats(L.newest(spark, path, 15), 15)


@query("audit_lookup", _sql("""
SELECT id, transaction_id, decision FROM audit WHERE user_id = 'user_7'"""))
def q_audit_lookup(spark, sf_dir):
    path = scratch_path(spark, "audit-lookup")
    A.audit_append(_audit(spark, sf_dir), path)
    return A.lookup(A.read_audit(spark, path), user_id="user_7").select(
        "id", "transaction_id", "decision")


@query("audit_table_view", _sql(f"""
SELECT strftime(created_at, {_TS}) AS time, id, transaction_id, risk_level, decision FROM audit"""))
def q_audit_table_view(spark, sf_dir):
    return A.table_view(_audit(spark, sf_dir))
