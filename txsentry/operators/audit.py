"""Append-only audit table and its queries.

The table is Parquet partitioned by ``created_date``; appends are atomic
per job (Spark's commit protocol), so a lost executor or a retried job
never leaves partial rows.  Reads of recent rows are top-k
(``TakeOrderedAndProject``: every task keeps only its own k best rows).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from txsentry.operators.scratch import stored
from txsentry.schema import REASON, TRANSACTION
from txsentry.sources.files import TS_FORMAT

logger = logging.getLogger(__name__)
PAYLOAD_FIELDS = TRANSACTION.fieldNames()
# JSON keeps event time to the microsecond (the default format keeps millis).
JSON_OPTIONS = {"timestampFormat": TS_FORMAT}
# Defaults of missing prediction fields in an audit row.
AUDIT_DEFAULTS = {"fraud_probability": 0.0, "anomaly_score": 0.0, "risk_level": "unknown",
                  "decision": "REVIEW"}
DEFAULT_RECENT = 20
MAX_RECENT = 100
STATS_WINDOW = 100
DASHBOARD_WINDOW = 15


def audit_rows(pred: DataFrame, id_col: str | None = None, batch_id: str = "0",
               created_at: str | None = "created_at") -> DataFrame:
    """Audit rows of a prediction table.

    ``id``: the given id column, else a deterministic hash of (batch,
    transaction) — a retried batch yields the same ids.  Missing scores
    become 0.0, a missing level "unknown", a missing decision "REVIEW",
    missing reasons [].
    """
    payload = F.to_json(F.struct(*[F.col(c) for c in PAYLOAD_FIELDS if c in pred.columns]),
                        JSON_OPTIONS)
    reasons = F.coalesce(F.col("top_reasons"), F.array().cast(ArrayType(REASON))) \
        if "top_reasons" in pred.columns else F.array().cast(ArrayType(REASON))
    rid = (F.col(id_col).cast("string") if id_col
           else F.sha2(F.concat_ws("|", F.lit(batch_id), F.col("transaction_id")), 256))
    created = F.col(created_at) if created_at and created_at in pred.columns \
        else F.date_trunc("second", F.current_timestamp())

    def col_or(c, default):
        return F.coalesce(F.col(c), F.lit(default)) if c in pred.columns else F.lit(default)

    return pred.select(
        rid.alias("id"), "transaction_id", "user_id",
        payload.alias("request_payload"),
        col_or("fraud_probability", AUDIT_DEFAULTS["fraud_probability"]).cast("double")
        .alias("fraud_probability"),
        col_or("anomaly_score", AUDIT_DEFAULTS["anomaly_score"]).cast("double")
        .alias("anomaly_score"),
        col_or("risk_level", AUDIT_DEFAULTS["risk_level"]).alias("risk_level"),
        col_or("decision", AUDIT_DEFAULTS["decision"]).alias("decision"),
        F.to_json(reasons).alias("top_reasons"),
        created.alias("created_at"),
    ).withColumn("created_date", F.to_date("created_at"))


# Point lookups by transaction or user skip row groups through Parquet bloom
# filters (equality filters are pushed to the scan).
BLOOM_OPTIONS = {"parquet.bloom.filter.enabled#transaction_id": "true",
                 "parquet.bloom.filter.enabled#user_id": "true"}


def audit_append(rows: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Append audit rows (one atomic job) to the date-partitioned table.

    With ``batch_id`` the rows land in (created_date, batch_id) partitions
    written with dynamic partition overwrite: re-running the same batch
    after a failure replaces its rows instead of adding them again."""
    w = rows
    if batch_id is None:
        w.write.mode("append").options(**BLOOM_OPTIONS).partitionBy("created_date").parquet(path)
        return
    (w.withColumn("batch_id", F.lit(str(batch_id)))
      .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
      .options(**BLOOM_OPTIONS).partitionBy("created_date", "batch_id").parquet(path))


def try_audit_append(rows: DataFrame, path: str, batch_id: str | None = None) -> bool:
    """Append, reporting failure instead of raising: the predictions being
    audited stand even when the audit write fails (streams use the
    replay-safe ``streaming.jobs.audit_to_table`` instead)."""
    try:
        audit_append(rows, path, batch_id)
        return True
    except Exception:  # noqa: BLE001 - any storage error
        logger.exception("audit append to %s failed", path)
        return False


def read_audit(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recent(audit: DataFrame, limit: int = DEFAULT_RECENT) -> DataFrame:
    """Newest ``limit`` rows (1..100), ties on created_at broken by id."""
    if not 1 <= limit <= MAX_RECENT:
        raise ValueError(f"limit must be in 1..{MAX_RECENT}, got {limit}")
    return audit.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def recent_from_table(spark, path: str, limit: int = DEFAULT_RECENT) -> DataFrame:
    """``recent`` on the date-partitioned table, reading only the newest
    partitions that can hold the answer: per-date row counts (no data
    columns are read; one row per date) give the oldest date needed, which
    becomes a partition filter of the top-k scan."""
    if not 1 <= limit <= MAX_RECENT:
        raise ValueError(f"limit must be in 1..{MAX_RECENT}, got {limit}")
    table = read_audit(spark, path)
    per_day = table.groupBy("created_date").agg(F.count(F.lit(1)).alias("n")) \
                   .orderBy(F.col("created_date").desc()).collect()
    covered, cutoff = 0, None
    for r in per_day:
        covered, cutoff = covered + r["n"], r["created_date"]
        if covered >= limit:
            break
    if cutoff is not None:
        table = table.filter(F.col("created_date") >= F.lit(cutoff))
    return recent(table, limit)


def parse_json(audit: DataFrame) -> DataFrame:
    """Payload and reasons text back to typed columns."""
    return audit.withColumns({
        "payload": F.from_json("request_payload", TRANSACTION, JSON_OPTIONS),
        "reasons": F.from_json("top_reasons", ArrayType(REASON)),
    })


def parse_json_variant(audit: DataFrame) -> DataFrame:
    """Free-form payloads: the request text as a VARIANT (no schema needed;
    fields read with ``variant_get``), e.g. for payloads with extra keys."""
    return audit.withColumn("payload_variant", F.parse_json("request_payload"))


def decision_window_stats(audit: DataFrame, window: int = STATS_WINDOW) -> DataFrame:
    """Counts per decision over the newest ``window`` rows."""
    r = recent(audit, window)
    d = F.col("decision")
    return r.agg(F.count(F.lit(1)).alias("window_size"),
                 F.count_if(d == "BLOCK").alias("blocks"),
                 F.count_if(d == "REVIEW").alias("reviews"),
                 F.count_if(d == "ALLOW").alias("allows"))


def dashboard_stats(audit: DataFrame, window: int = DASHBOARD_WINDOW) -> DataFrame:
    r = recent(audit, window)
    d = F.col("decision")
    return r.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(d == "ALLOW").alias("allowed"),
                 F.count_if(d == "REVIEW").alias("review"),
                 F.count_if(d == "BLOCK").alias("blocked"))


def lookup(audit: DataFrame, transaction_id: str | None = None,
           user_id: str | None = None) -> DataFrame:
    """Rows of one transaction and/or one user (pushed down to the scan)."""
    out = audit
    if transaction_id is not None:
        out = out.filter(F.col("transaction_id") == transaction_id)
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    return out


def table_view(audit: DataFrame) -> DataFrame:
    """Display projection, newest first."""
    return audit.select(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("time"),
                        "id", "transaction_id", "risk_level", "decision") \
                .orderBy(F.col("time").desc(), F.col("id").desc())


def keyed_latest(rows: DataFrame, key: str = "transaction_id",
                 order: str = "created_at") -> DataFrame:
    """One row per key: the latest by ``order`` (ties: largest row).  A
    grouped max of a struct, so duplicates of one key are combined map-side
    instead of being sorted in one task."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *others)).alias("_r"))
    return best.select(key, "_r.*")


def keyed_store(new_rows: DataFrame, existing: DataFrame | None,
                key: str = "transaction_id", order: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(to_insert, refused): rows whose key is new (deduplicated within the
    batch, latest wins), and all others: rows without a key, rows that lost the
    in-batch dedup and rows whose key exists already.  ``operators.keyed_table``
    keeps the table itself."""
    from txsentry.operators.keyed_table import judge
    judged = stored(judge(new_rows, existing, key, order), "keyed-judged")
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL").drop("reason")
