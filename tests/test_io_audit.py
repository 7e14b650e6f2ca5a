"""Sources/sinks round trips and the audit/keyed store semantics."""

import os

import pytest
from pyspark.sql import functions as F

from txsentry.operators import audit as A
from txsentry.operators import risk as R
from txsentry.session import scratch_path
from txsentry.sources import files as S
from txsentry.sources.tables import scored_from
from txsentry.schema import LABELLED_ORDER


def test_csv_prefers_first_existing(spark, tx_small):
    d = scratch_path(spark, "csv")
    S.write_labelled_csv(tx_small, os.path.join(d, "v1.csv"))
    S.write_labelled_csv(tx_small.limit(10), os.path.join(d, "v2.csv"))
    assert S.read_labelled_csv(spark, [os.path.join(d, "v2.csv"),
                                       os.path.join(d, "v1.csv")]).count() == 10
    assert S.read_labelled_csv(spark, [os.path.join(d, "missing.csv"),
                                       os.path.join(d, "v1.csv")]).count() == tx_small.count()
    with pytest.raises(FileNotFoundError):
        S.read_labelled_csv(spark, [os.path.join(d, "nope.csv")])


def test_csv_header_order_and_round_trip(spark, tx_small):
    d = scratch_path(spark, "csv")
    S.write_labelled_csv(tx_small, d)
    assert spark.read.option("header", "true").csv(d).columns == LABELLED_ORDER
    back = S.read_labelled_csv(spark, d).select(*LABELLED_ORDER)
    assert back.exceptAll(tx_small.select(*LABELLED_ORDER)).count() == 0


def test_json_round_trip_keeps_microseconds(spark, tx_small):
    d = scratch_path(spark, "json")
    S.write_transactions_json(tx_small, d)
    back = S.read_transactions_json(spark, d, labelled=True).select(*LABELLED_ORDER)
    assert back.exceptAll(tx_small.select(*LABELLED_ORDER)).count() == 0


def test_from_records_missing_fields_null(spark):
    df = S.from_records(spark, [{"transaction_id": "a", "amount": 3.5}, {"user_id": "u"}])
    rows = df.collect()
    assert rows[0].amount == "3.5" and rows[0].user_id is None and rows[1].transaction_id is None


def _keyed_rows(tx):
    pred = R.assess(scored_from(tx))
    return pred.select("transaction_id", "user_id", "amount",
                       F.col("combined_score").alias("risk_score"), "decision",
                       F.col("created_at").alias("timestamp"))


def test_keyed_store_dedups_and_quarantines(spark, tx_small):
    rows = _keyed_rows(tx_small)
    later = rows.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR")) \
                .withColumn("decision", F.lit("REVIEW"))
    # In-batch duplicates: the later copy wins, the earlier one is quarantined.
    ins, dup = A.keyed_store(rows.unionByName(later), None, order="timestamp")
    assert ins.count() == tx_small.count()
    assert ins.filter(F.col("decision") != "REVIEW").count() == 0
    assert dup.count() == tx_small.count()
    # Keys already stored: nothing inserted, all quarantined.
    ins2, dup2 = A.keyed_store(rows, ins, order="timestamp")
    assert ins2.count() == 0 and dup2.count() == tx_small.count()


def test_audit_defaults_for_missing_fields(spark, tx_small):
    bare = tx_small.select("transaction_id", "user_id")
    r = A.audit_rows(bare, created_at=None).first()
    assert (r.fraud_probability, r.anomaly_score, r.risk_level, r.decision, r.top_reasons) == \
        (0.0, 0.0, "unknown", "REVIEW", "[]")


def test_audit_ids_stable_across_replays(spark, tx_small):
    a = A.audit_rows(tx_small.select("transaction_id", "user_id"), batch_id="3")
    b = A.audit_rows(tx_small.select("transaction_id", "user_id"), batch_id="3")
    assert a.select("id").exceptAll(b.select("id")).count() == 0


def test_recent_limit_bounds(spark, tx_small):
    audit = A.audit_rows(R.assess(scored_from(tx_small)), id_col="id")
    assert A.recent(audit, 100).count() == 100
    for bad in (0, 101):
        with pytest.raises(ValueError):
            A.recent(audit, bad)


def test_audit_failure_is_reported_not_raised(spark, tx_small, tmp_path):
    blocker = tmp_path / "not_a_dir"
    blocker.write_text("x")  # a file where the table folder should be
    rows = A.audit_rows(R.assess(scored_from(tx_small)), id_col="id")
    assert A.try_audit_append(rows, str(blocker)) is False
    ok_path = scratch_path(spark, "audit-ok")
    assert A.try_audit_append(rows, ok_path) is True
    assert spark.read.parquet(ok_path).count() == tx_small.count()


def test_payload_as_variant(spark, tx_small):
    rows = A.parse_json_variant(A.audit_rows(R.assess(scored_from(tx_small)), id_col="id"))
    got = rows.select("transaction_id",
                      F.variant_get("payload_variant", "$.amount", "double").alias("a"))
    ref = tx_small.select("transaction_id", F.col("amount").alias("a"))
    assert got.exceptAll(ref).count() == 0


def test_recent_from_table_prunes_partitions(spark, tx_small):
    import contextlib
    import io
    audit = A.audit_rows(R.assess(scored_from(tx_small)), id_col="id")
    path = scratch_path(spark, "audit-recent")
    A.audit_append(audit, path)
    got = A.recent_from_table(spark, path, 20)
    want = A.recent(A.read_audit(spark, path), 20)
    assert [r.id for r in got.collect()] == [r.id for r in want.collect()]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        got.explain()
    assert "PartitionFilters: [isnotnull(created_date" in buf.getvalue()


def test_audit_batch_rerun_is_idempotent(spark, tx_small):
    rows = A.audit_rows(R.assess(scored_from(tx_small)), id_col="id")
    path = scratch_path(spark, "audit-batches")
    A.audit_append(rows, path, batch_id="b1")
    A.audit_append(rows, path, batch_id="b1")   # the same batch re-run
    assert A.read_audit(spark, path).count() == tx_small.count()
    A.audit_append(rows.limit(10), path, batch_id="b2")
    assert A.read_audit(spark, path).count() == tx_small.count() + 10
