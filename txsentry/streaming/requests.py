"""The request path as one job (T1 + T2 + T3): validate, score, audit.

A batch of raw requests is checked in one pass over its source, which also
counts the violations of every rule on the way (``observe``), and is staged as
accepted and refused rows; accepted rows are normalised, scored and audited.
All four outputs are written under the id of the batch and become visible
together when the audit log's manifest row is written, as the last step
(``operators.audit_log``).  A job that dies between two sinks leaves nothing
that a reader sees; its repetition writes the batch anew, and a batch that was
committed is not processed again.  So each request is answered once, also
when the stream restarts between the commit and its own checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentry.functions import validate as VF
from txsentry.operators import audit as A
from txsentry.operators import audit_log as L
from txsentry.operators import validate as V
from txsentry.schema import PREDICTION, TRANSACTION
from txsentry.streaming.jobs import AVAILABLE_NOW, run_of

# Response columns that a scorer adds to the accepted request rows; the
# response's own time is apart from the request's event time.
RESPONSE = [f for f in PREDICTION.names if f not in ("transaction_id", "timestamp")]
Scorer = Callable[[DataFrame], DataFrame]


def audit_path(root: str) -> str:
    return f"{root}/audit"


def batch_key(run_id: str, batch_id: int | str) -> str:
    return f"{run_id}-{batch_id}"


def check(raw: DataFrame) -> tuple[DataFrame, Observation, list[str]]:
    """``raw`` with ``errors`` and ``valid``; an observation of rows, accepted
    rows and rows per rule, filled by whichever job first runs the result; and
    the rules in the order of the observation's counts."""
    raw = V.with_missing_columns(raw)
    rules = VF.request_rules({f.name: f.dataType.typeName() for f in raw.schema.fields})
    seen = Observation()
    tagged = V.validate(raw).withColumn("valid", F.size("errors") == 0)
    counts = [F.count_if(F.coalesce(cond, F.lit(False))).alias(f"r{k}") for k, (_, cond) in enumerate(rules)]
    tagged = tagged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("accepted"), *counts)
    return tagged, seen, [tag for tag, _ in rules]


def process(raw: DataFrame, root: str, score: Scorer, run_id: str, batch_id: int | str, default_ts=None) -> bool:
    """Answer one batch of raw requests; False if it was answered before.

    ``score`` adds the response columns to normalised request rows.
    """
    spark = raw.sparkSession
    key = batch_key(run_id, batch_id)
    if L.is_published(spark, audit_path(root), key):
        return False

    def put(df: DataFrame, sink: str, *by: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{sink}/append={key}")
        return spark.read.schema(df.schema).parquet(f"{root}/{sink}/append={key}")

    tagged, seen, rules = check(raw)
    checked = put(tagged, "checked", "valid")
    counts = seen.get
    accepted = put(V.normalize(checked.filter("valid"), default_ts).select(*TRANSACTION.names), "accepted")
    scored = put(score(accepted).select(*TRANSACTION.names, *RESPONSE, F.current_timestamp().alias("answered_at")), "predictions")
    L.stage(A.audit_rows(scored, batch_id=key, created_at="answered_at"), audit_path(root), key)
    L.publish(spark, audit_path(root), key, {"requests": counts["rows"], "accepted": counts["accepted"]}
              | {f"error/{tag}": counts[f"r{k}"] for k, tag in enumerate(rules) if counts[f"r{k}"]})
    return True


def stream(raw: DataFrame, root: str, score: Scorer, checkpoint: str, default_ts=None, trigger: dict = AVAILABLE_NOW):
    """``process`` on every micro-batch of a request stream."""
    run_id = run_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch, root, score, run_id, batch_id, default_ts)

    return (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start())


def _sink(spark: SparkSession, root: str, sink: str, schema: T.StructType) -> DataFrame:
    schema = T.StructType([*schema.fields, T.StructField("append", T.StringType())])
    at = f"{root}/{sink}"
    if not L.exists(spark, at):
        return spark.createDataFrame([], schema)
    return L.published(spark.read.schema(schema).parquet(at), spark, audit_path(root))


def accepted(spark: SparkSession, root: str) -> DataFrame:
    """Normalised requests of all committed batches."""
    return _sink(spark, root, "accepted", TRANSACTION)


def quarantine(spark: SparkSession, root: str, raw_schema: T.StructType) -> DataFrame:
    """Refused requests as they came, with their errors."""
    held = T.StructType([*raw_schema.fields, T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("valid", T.BooleanType())])
    return _sink(spark, root, "checked", held).filter("NOT valid").drop("valid")


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """Responses (PREDICTION columns, ``timestamp`` being the time of the answer) with the request's ``event_time``."""
    held = T.StructType([*TRANSACTION.fields, *[PREDICTION[c] for c in RESPONSE], T.StructField("answered_at", T.TimestampType())])
    return _sink(spark, root, "predictions", held).select(
        "transaction_id", *RESPONSE, F.col("answered_at").alias("timestamp"), F.col("timestamp").alias("event_time"), "append")


def audit(spark: SparkSession, root: str) -> DataFrame:
    return L.read(spark, audit_path(root))


def error_counts(spark: SparkSession, root: str) -> DataFrame:
    """(error, n) over all committed batches, as counted while they were checked."""
    return (L.manifest(spark, audit_path(root)).select(F.explode("info").alias("k", "n")).filter("k LIKE 'error/%'")
            .groupBy(F.substring("k", 7, 1 << 20).alias("error")).agg(F.sum("n").alias("n")))
