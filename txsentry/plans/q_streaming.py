"""Registered streaming queries (T1-T7): the driver's ``events`` file as a
stream, processed with ``availableNow`` into a memory table or through
``foreachBatch`` into tables.  Windowed results are the windows closed by
the final watermark (max event time - 1 hour); the oracles compute the
same windows in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txsentry.operators import audit_log as L
from txsentry.operators import keyed_table as K
from txsentry.operators import reasons as X
from txsentry.operators import risk as risk_ops
from txsentry.plans.catalog import query
from txsentry.plans.oracle import sround, with_views
from txsentry.plans.q_models import CHECKED_SQL, checked
from txsentry.plans.q_validate import _REJECT_SQL
from txsentry.session import scratch_path
from txsentry.sources.tables import raw_from, scored_from
from txsentry.streaming import jobs as T

_FMT = "yyyy-MM-dd HH:mm:ss"
_FMT_SQL = "'%Y-%m-%d %H:%M:%S'"
_WM = "(SELECT max(timestamp) - INTERVAL 1 HOUR FROM transactions)"


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:8]}"


@query("stream_velocity", with_views(f"""
SELECT user_id, strftime(ws, {_FMT_SQL}) AS window_start, count(*) AS n_tx
FROM (SELECT user_id, time_bucket(INTERVAL 5 MINUTES, timestamp) - k * INTERVAL 5 MINUTES AS ws
      FROM transactions, range(0, 3) r(k)) w
WHERE ws + INTERVAL 15 MINUTES <= {_WM}
GROUP BY user_id, ws"""))
def q_stream_velocity(spark, sf_dir):
    out = T.run_available(T.velocity_counts(T.transactions_stream(spark, sf_dir)),
                          _name("velocity"), scratch_path(spark, "ck-velocity"))
    return out.select("user_id", F.date_format("window_start", _FMT).alias("window_start"), "n_tx")


_GAP_MIN = 120


@query("stream_bursts", with_views(f"""
SELECT user_id, strftime(min(timestamp), {_FMT_SQL} || '.%f') AS session_start, count(*) AS n_tx,
       count(DISTINCT merchant_id) AS n_merchants, {sround('sum(amount)', 2)} AS total_amount
FROM (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY timestamp, transaction_id
                              ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL
                 OR timestamp >= lag(timestamp) OVER w + INTERVAL {_GAP_MIN} MINUTES
                 THEN 1 ELSE 0 END AS st
            FROM transactions
            WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, transaction_id)) a) b
GROUP BY user_id, sid
HAVING max(timestamp) + INTERVAL {_GAP_MIN} MINUTES <= {_WM}"""))
def q_stream_bursts(spark, sf_dir):
    out = T.run_available(T.burst_sessions(T.transactions_stream(spark, sf_dir), f"{_GAP_MIN} minutes"),
                          _name("bursts"), scratch_path(spark, "ck-bursts"))
    return out.select("user_id", F.date_format("session_start", _FMT + ".SSSSSS")
                      .alias("session_start"), "n_tx", F.col("n_merchants").cast("long").alias("n_merchants"),
                      F.round("total_amount", 2).alias("total_amount"))


@query("stream_decisions", with_views(f"""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, timestamp), {_FMT_SQL}) AS window_start, decision,
       count(*) AS n
FROM (SELECT timestamp, CASE WHEN s <= 0.2 THEN 'ALLOW' WHEN s <= 0.5 THEN 'REVIEW'
                             ELSE 'BLOCK' END AS decision
      FROM (SELECT timestamp, least(1.0, greatest(0.0, 0.6 * fraud_probability
                   + 0.4 * anomaly_score)) AS s FROM scored) a) b
WHERE time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR <= {_WM}
GROUP BY 1, decision""", views=("scored",)))
def q_stream_decisions(spark, sf_dir):
    pred = risk_ops.assess(scored_from(T.transactions_stream(spark, sf_dir)))
    out = T.run_available(T.decision_counts(pred), _name("decisions"),
                          scratch_path(spark, "ck-decisions"))
    return out.select(F.date_format("window_start", _FMT).alias("window_start"), "decision", "n")


@query("stream_dedup", with_views("SELECT DISTINCT transaction_id FROM transactions"))
def q_stream_dedup(spark, sf_dir):
    out = T.run_available(T.dedup(T.transactions_stream(spark, sf_dir)), _name("dedup"),
                          scratch_path(spark, "ck-dedup"))
    return out.select("transaction_id")


@query("stream_keyed_store", with_views("SELECT transaction_id, max(amount) AS amount FROM transactions GROUP BY transaction_id"))
def q_stream_keyed_store(spark, sf_dir):
    tx, path = T.transactions_stream(spark, sf_dir), scratch_path(spark, "keyed-stream")
    T.keyed_to_table(tx, path, scratch_path(spark, "ck-keyed")).awaitTermination()
    return K.read(spark, path, tx.schema).select("transaction_id", "amount")


@query("stream_validate", f"SELECT transaction_id, n_errors FROM ({_REJECT_SQL}) r WHERE accepted = 0")
def q_stream_validate(spark, sf_dir):
    raw = raw_from(T.transactions_stream(spark, sf_dir))
    acc, quar = scratch_path(spark, "accepted"), scratch_path(spark, "quarantine")
    T.validate_to_tables(raw, acc, quar, scratch_path(spark, "ck-validate")).awaitTermination()
    return spark.read.parquet(quar).select("transaction_id", F.size("errors").alias("n_errors"))


@query("stream_audit", with_views("""
SELECT transaction_id, CASE WHEN s <= 0.2 THEN 'ALLOW' WHEN s <= 0.5 THEN 'REVIEW'
                            ELSE 'BLOCK' END AS decision
FROM (SELECT transaction_id, least(1.0, greatest(0.0, 0.6 * fraud_probability
             + 0.4 * anomaly_score)) AS s FROM scored) a""", views=("scored",)))
def q_stream_audit(spark, sf_dir):
    pred = X.with_top_reasons(risk_ops.assess(scored_from(T.transactions_stream(spark, sf_dir))))
    path = scratch_path(spark, "audit-stream")
    T.audit_to_table(pred, path, scratch_path(spark, "ck-audit")).awaitTermination()
    return L.read(spark, path).select("transaction_id", "decision")


@query("stream_score", CHECKED_SQL)
def q_stream_score(spark, sf_dir):
    from txsentry.plans import scoring as P
    from txsentry.sources.tables import transactions
    scorer, parts = P.train(spark, transactions(spark, sf_dir))
    parts.unpersist()
    pred = checked(P.score(scorer, T.transactions_stream(spark, sf_dir)))
    return T.run_available(pred, _name("scores"), scratch_path(spark, "ck-score"))
