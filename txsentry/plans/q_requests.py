"""Registered queries of the whole request path (T1 + T2 + T3) and of the
audit log's zone manifest.

The scores are those of the explanation rules (``scoring.rule_responses``), so
every column has an SQL form; ``stream_score`` scores with trained models.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from txsentry.operators import audit as A
from txsentry.operators import audit_log as L
from txsentry.plans import scoring as P
from txsentry.plans.catalog import query
from txsentry.plans.oracle import sround, with_views
from txsentry.plans.q_audit import _audit, _sql
from txsentry.plans.q_validate import _ALL_SQL, _REJECT_SQL, _errors_sql
from txsentry.schema import FALSE_TEXT, TRUE_TEXT
from txsentry.session import scratch_path
from txsentry.sources.tables import raw_from, raw_transactions
from txsentry.streaming import jobs as T
from txsentry.streaming import requests as Q


def _flag(c: str, default: str) -> str:
    texts = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return (f"CASE WHEN lower(trim({c})) IN ({texts(TRUE_TEXT)}) THEN true "
            f"WHEN lower(trim({c})) IN ({texts(FALSE_TEXT)}) THEN false ELSE {default} END")


_ANSWERS_SQL = with_views(f"""
SELECT r.transaction_id, CASE WHEN accepted = 1 THEN 'answered' ELSE 'refused' END AS outcome, n_errors, risk_level, decision,
  {sround(sround('p', 6), 4)} AS fraud_probability, {sround(sround('a', 6), 4)} AS anomaly_score,
  strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, accepted AS audited
FROM ({_REJECT_SQL}) r LEFT JOIN (
  SELECT *, CASE WHEN s <= 0.2 THEN 'low' WHEN s <= 0.5 THEN 'medium' WHEN s <= 0.75 THEN 'high' ELSE 'critical' END AS risk_level,
    CASE WHEN s <= 0.2 THEN 'ALLOW' WHEN s <= 0.5 THEN 'REVIEW' ELSE 'BLOCK' END AS decision
  FROM (SELECT *, least(1.0, greatest(0.0, 0.6 * p + 0.4 * a)) AS s FROM (
    SELECT transaction_id, event_time, amount / (amount + 5000) AS a,
      least(1.0, CAST(CASE WHEN amount > 10000 THEN 0.5 WHEN amount > 5000 THEN 0.25 ELSE 0 END AS DOUBLE)
        + CAST(CASE WHEN hour(event_time) >= 22 OR hour(event_time) < 6 THEN 0.3 ELSE 0 END AS DOUBLE)
        + CAST(CASE WHEN intl THEN 0.2 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN card THEN 0 ELSE 0.15 END AS DOUBLE)
        + CAST(CASE WHEN device = 'unknown' THEN 0.1 ELSE 0 END AS DOUBLE)) AS p
    FROM (SELECT transaction_id, round(TRY_CAST(amount AS DOUBLE), 2) AS amount, TRY_CAST(timestamp AS TIMESTAMP) AS event_time,
            lower(coalesce(device_type, 'unknown')) AS device, {_flag('is_international', 'false')} AS intl,
            {_flag('card_present', 'true')} AS card
          FROM raw_transactions) x) y) z
) z ON z.transaction_id = r.transaction_id AND r.accepted = 1""", views=("raw_transactions",))


def _answers(spark, root, raw_schema):
    """One row per request from the four published sinks."""
    audit = A.parse_json(Q.audit(spark, root)).select("transaction_id", F.date_format("payload.timestamp", "yyyy-MM-dd HH:mm:ss").alias("t"))
    answered = (Q.predictions(spark, root).join(Q.accepted(spark, root).select("transaction_id"), "transaction_id")
                .join(audit, "transaction_id", "left")
                .select("transaction_id", F.lit("answered").alias("outcome"), F.lit(0).alias("n_errors"), "risk_level", "decision",
                        "fraud_probability", "anomaly_score", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
                        (F.col("t") == F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")).cast("int").alias("audited")))
    null = {c: F.lit(None).cast(t) for c, t in (("risk_level", "string"), ("decision", "string"), ("fraud_probability", "double"),
                                                ("anomaly_score", "double"), ("event_time", "string"))}
    refused = Q.quarantine(spark, root, raw_schema).select(
        "transaction_id", F.lit("refused").alias("outcome"), F.size("errors").alias("n_errors"),
        *[v.alias(k) for k, v in null.items()], F.lit(0).alias("audited"))
    return answered.unionByName(refused)


@query("request_path", _ANSWERS_SQL)
def q_request_path(spark, sf_dir):
    raw, root = raw_transactions(spark, sf_dir), scratch_path(spark, "requests")
    Q.process(raw, root, P.rule_responses, "batch", 0)
    return _answers(spark, root, raw.schema)


@query("stream_request_path", _ANSWERS_SQL)
def q_stream_request_path(spark, sf_dir):
    raw, root = raw_from(T.transactions_stream(spark, sf_dir)), scratch_path(spark, "requests-stream")
    Q.stream(raw, root, P.rule_responses, scratch_path(spark, "ck-requests")).awaitTermination()
    return _answers(spark, root, raw.schema)


@query("reject_counts_on_the_way", with_views(f"SELECT error, count(*) AS n FROM ({_errors_sql(_ALL_SQL)}) z GROUP BY error",
                                              views=("raw_transactions",)))
def q_reject_counts_on_the_way(spark, sf_dir):
    """Violations per rule, counted by the job that answered the requests."""
    root = scratch_path(spark, "requests")
    Q.process(raw_transactions(spark, sf_dir), root, P.rule_responses, "batch", 0)
    return Q.error_counts(spark, root)


def _log(spark, sf_dir) -> str:
    """The feed's audit rows, appended to a fresh log as one append."""
    path = scratch_path(spark, "audit-log")
    L.append(_audit(spark, sf_dir), path, "feed")
    return path


@query("audit_log_page", _sql("""
SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS time, id, transaction_id, risk_level, decision
FROM (SELECT * FROM recent LIMIT 100) r"""))
def q_audit_log_page(spark, sf_dir):
    """The display's newest page, read through the zones."""
    return A.table_view(L.newest(spark, _log(spark, sf_dir), A.MAX_RECENT))


@query("audit_log_totals", _sql("""
SELECT strftime(created_at, '%Y-%m-%d') AS created_date, decision, count(*) AS n FROM audit GROUP BY 1, 2"""))
def q_audit_log_totals(spark, sf_dir):
    """Rows per day and decision, from the manifest alone."""
    return L.decision_totals(spark, _log(spark, sf_dir)).select(
        F.date_format("created_date", "yyyy-MM-dd").alias("created_date"), "decision", "n")
