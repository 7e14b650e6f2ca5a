"""Structured Streaming jobs.

The batch operators are DataFrame -> DataFrame functions, so the stateless
ones (validation, features, scoring, tiering, reasons) run on a stream
unchanged.  Stateful ones use Spark's event-time machinery: a watermark
with one delay parameter, sliding / tumbling / session windows in append
mode (a window is emitted once the watermark passes its end) and
``dropDuplicatesWithinWatermark`` for at-most-once keys.  Sinks that write
tables go through ``foreachBatch`` and overwrite the partition of their
batch id, so a replayed micro-batch (after a failure) rewrites the same
rows instead of appending them twice.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentry.operators import audit as A
from txsentry.operators import audit_log as L
from txsentry.operators import keyed_table as K
from txsentry.operators import validate as V
from txsentry.sources.tables import read_table, transactions_from

DEFAULT_DELAY = "1 hour"


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None
                  ) -> DataFrame:
    """The driver's ``events`` table as a file stream (event time as TIMESTAMP)."""
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(sf_dir)
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))


def transactions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled transaction stream: events stream joined to the static customer table."""
    return transactions_from(events_stream(spark, sf_dir), read_table(spark, sf_dir, "customer"))


def run_available(df: DataFrame, name: str, checkpoint: str, path: str | None = None
                  ) -> DataFrame:
    """Process everything available now into a Parquet table (append mode;
    exactly-once through the file sink's metadata log) and return it.  The
    result stays distributed — no memory sink on the driver.  Services pass
    a processing-time trigger to the table sinks below instead."""
    from txsentry.session import scratch_path
    path = path or scratch_path(df.sparkSession, f"stream-{name}")
    q = (df.writeStream.format("parquet").option("path", path).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .queryName(name).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def velocity_counts(tx: DataFrame, window: str = "15 minutes", slide: str = "5 minutes",
                    delay: str = DEFAULT_DELAY) -> DataFrame:
    """Rows per user in sliding event-time windows (T4)."""
    return (tx.withWatermark("timestamp", delay)
              .groupBy(F.window("timestamp", window, slide).alias("w"), "user_id")
              .agg(F.count(F.lit(1)).alias("n_tx"))
              .select("user_id", F.col("w.start").alias("window_start"),
                      F.col("w.end").alias("window_end"), "n_tx"))


def burst_sessions(tx: DataFrame, gap: str = "4 minutes", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Per-user session windows (T5): rows, distinct merchants, amount."""
    return (tx.withWatermark("timestamp", delay)
              .groupBy(F.session_window("timestamp", gap).alias("s"), "user_id")
              .agg(F.count(F.lit(1)).alias("n_tx"),
                   F.size(F.collect_set("merchant_id")).alias("n_merchants"),
                   F.sum("amount").alias("total_amount"))
              .select("user_id", F.col("s.start").alias("session_start"),
                      F.col("s.end").alias("session_end"), "n_tx", "n_merchants",
                      "total_amount"))


def decision_counts(pred: DataFrame, window: str = "1 hour",
                    delay: str = DEFAULT_DELAY) -> DataFrame:
    """Tumbling-window counts per decision."""
    return (pred.withWatermark("timestamp", delay)
                .groupBy(F.window("timestamp", window).alias("w"), "decision")
                .agg(F.count(F.lit(1)).alias("n"))
                .select(F.col("w.start").alias("window_start"), "decision", "n"))


def dedup(tx: DataFrame, key: str = "transaction_id", delay: str = DEFAULT_DELAY) -> DataFrame:
    """At most one row per key among rows within the watermark delay."""
    return tx.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([key])


AVAILABLE_NOW = {"availableNow": True}


def run_of(checkpoint: str) -> str:
    """Id of the run that a checkpoint stands for: batch numbers start again
    at 0 with a new checkpoint, so sinks keep each run's batches apart."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def validate_to_tables(raw: DataFrame, accepted_path: str, quarantine_path: str,
                       checkpoint: str, default_ts=None, trigger: dict = AVAILABLE_NOW):
    """Split each micro-batch into the accepted and quarantine tables
    (partitions of run and batch: a replay overwrites its own only)."""
    run = run_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # two sinks read the micro-batch: compute it once
        try:
            accepted, rejected = V.split(batch, default_ts)
            for df, path in ((accepted, accepted_path), (rejected, quarantine_path)):
                (df.withColumns({"run_id": F.lit(run), "batch_id": F.lit(batch_id)})
                   .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                   .partitionBy("run_id", "batch_id").parquet(path))
        finally:
            batch.unpersist()

    return (raw.writeStream.foreachBatch(write)
               .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def audit_to_table(pred: DataFrame, path: str, checkpoint: str, id_col: str | None = None,
                   trigger: dict = AVAILABLE_NOW):
    """Every micro-batch is one append of the audit log (``operators.audit_log``:
    day folders and a manifest row).  Ids hash (run, batch, transaction); a
    replayed batch is not written again, and a run with a new checkpoint keeps
    the earlier rows."""
    run = run_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        key = f"{run}-{batch_id}"
        L.append(A.audit_rows(batch, id_col=id_col, batch_id=key), path, key)

    return (pred.writeStream.foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def keyed_to_table(rows: DataFrame, path: str, checkpoint: str, key: str = "transaction_id", order: str = "timestamp",
                   trigger: dict = AVAILABLE_NOW):
    """T7 beyond the watermark: every micro-batch is one insert of the keyed
    table (``operators.keyed_table``), so a key is stored once however late its
    copies come, and refused rows are kept with their reason."""
    run = run_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        K.insert(batch, path, f"{run}-{batch_id}", key, order)

    return (rows.writeStream.foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(**trigger).start())
