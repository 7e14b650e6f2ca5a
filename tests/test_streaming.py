"""Streaming: same function on batch and stream, idempotent replays,
late rows behind the watermark."""

import datetime as dt
import os

from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from txsentry.operators import audit as A
from txsentry.operators import risk as R
from txsentry.operators import validate as V
from txsentry.plans import scoring as P
from txsentry.session import scratch_path
from txsentry.sources.tables import raw_from, scored_from
from txsentry.streaming import jobs as T


def test_stream_validate_equals_batch(spark, tx_small):
    raw_batch = raw_from(tx_small)
    _, rej_batch = V.split(raw_batch)
    raw = raw_from(T.transactions_stream(spark, SF_SMALL))
    acc, quar = scratch_path(spark, "acc"), scratch_path(spark, "quar")
    T.validate_to_tables(raw, acc, quar, scratch_path(spark, "ck")).awaitTermination()
    got = spark.read.parquet(quar).select("transaction_id")
    assert sorted(got.toPandas()["transaction_id"]) == \
        sorted(rej_batch.toPandas()["transaction_id"])
    assert spark.read.parquet(acc).count() + got.count() == tx_small.count()


def test_foreach_batch_replay_is_idempotent(spark, tx_small):
    pred = R.assess(scored_from(tx_small))
    path = scratch_path(spark, "audit")
    for _ in range(2):  # the same micro-batch written twice (a replay)
        rows = A.audit_rows(pred, batch_id="7").withColumn("batch_id", F.lit(7))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(path)
    back = spark.read.parquet(path)
    assert back.count() == tx_small.count()
    assert back.select("id").distinct().count() == tx_small.count()


def test_stream_score_equals_batch(spark, tx_small):
    scorer, _ = P.train(spark, tx_small, max_iter=3, forest_trees=10)
    batch = P.score(scorer, tx_small).select("transaction_id", "fraud_probability",
                                             "anomaly_score", "decision")
    stream = P.score(scorer, T.transactions_stream(spark, SF_SMALL))
    out = T.run_available(stream.select("transaction_id", "fraud_probability",
                                        "anomaly_score", "decision"),
                          "score_eq", scratch_path(spark, "ck"))
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_late_rows_dropped_by_watermark(spark, tmp_path):
    src = str(tmp_path / "src")
    os.makedirs(src)
    schema = "transaction_id string, user_id string, timestamp timestamp"
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    first = [("a", "u", t0), ("b", "u", t0 + dt.timedelta(hours=5))]
    late = [("c", "u", t0 + dt.timedelta(minutes=1))]  # 5 h behind the watermark
    spark.createDataFrame(first, schema).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    counts = T.velocity_counts(stream, "1 hour", "1 hour", "10 minutes")
    q = (counts.writeStream.format("memory").queryName("late_chk").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    spark.createDataFrame(late, schema).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    rows = spark.table("late_chk").collect()
    # Only the 12:00 window closed (watermark 16:50); the late row never counts.
    assert [(r.window_start.hour, r.n_tx) for r in rows] == [(12, 1)]


def test_dedup_within_watermark(spark, tx_small):
    dup = T.transactions_stream(spark, SF_SMALL)
    out = T.run_available(T.dedup(dup.unionByName(dup)), "dedup_chk", scratch_path(spark, "ck"))
    assert out.count() == tx_small.count()
