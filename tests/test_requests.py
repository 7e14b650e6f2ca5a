"""The request path as one job, and the audit log's zone manifest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from txsentry.operators import audit as A
from txsentry.operators import audit_log as L
from txsentry.operators import validate as V
from txsentry.plans import scoring as P
from txsentry.session import scratch_path
from txsentry.sources.tables import raw_from, scored_from
from txsentry.streaming import jobs as T
from txsentry.streaming import requests as Q


def counts(spark, root, schema):
    return (Q.accepted(spark, root).count(), Q.quarantine(spark, root, schema).count(), Q.predictions(spark, root).count(),
            Q.audit(spark, root).count())


def want(raw):
    accepted, refused = V.split(raw)
    return accepted.count(), refused.count()


def test_nothing_is_visible_after_a_crash_between_two_sinks(spark, tx_small, monkeypatch):
    batch = raw_from(tx_small)
    n_ok, n_bad = want(batch)
    raw = raw_from(T.transactions_stream(spark, SF_SMALL))
    root, ck = scratch_path(spark, "requests"), scratch_path(spark, "ck")
    with monkeypatch.context() as m:
        m.setattr(L, "stage", lambda *a: (_ for _ in ()).throw(OSError("disk gone")))
        with pytest.raises(Exception, match="disk gone"):
            Q.stream(raw, root, P.rule_responses, ck).awaitTermination()
    # accepted, quarantine and predictions have been written, none is published
    assert L.exists(spark, f"{root}/predictions") and counts(spark, root, batch.schema) == (0, 0, 0, 0)
    Q.stream(raw, root, P.rule_responses, ck).awaitTermination()      # the same batch again
    assert counts(spark, root, batch.schema) == (n_ok, n_bad, n_ok, n_ok)
    Q.stream(raw, root, P.rule_responses, ck).awaitTermination()      # nothing new
    assert counts(spark, root, batch.schema) == (n_ok, n_bad, n_ok, n_ok)


def test_a_committed_batch_is_not_answered_again(spark, tx_small):
    raw, root = raw_from(tx_small), scratch_path(spark, "requests")
    n_ok, n_bad = want(raw)
    assert Q.process(raw, root, P.rule_responses, "run", 3)
    before = sorted(r.id for r in Q.audit(spark, root).select("id").collect())
    assert not Q.process(raw, root, P.rule_responses, "run", 3)
    assert sorted(r.id for r in Q.audit(spark, root).select("id").collect()) == before
    assert Q.process(raw, root, P.rule_responses, "another run", 3)   # its batches are its own
    assert counts(spark, root, raw.schema) == (2 * n_ok, 2 * n_bad, 2 * n_ok, 2 * n_ok)


def test_counts_are_taken_on_the_way(spark, tx_small):
    raw, root = raw_from(tx_small), scratch_path(spark, "requests")
    Q.process(raw, root, P.rule_responses, "run", 0)
    summary = {r.error: r.n for r in V.reject_summary(raw).collect()}
    assert {r.error: r.n for r in Q.error_counts(spark, root).collect()} == summary
    info = L.manifest(spark, Q.audit_path(root)).first()["info"]
    assert info["requests"] == raw.count() and info["accepted"] == want(raw)[0]


def test_event_time_is_kept_and_requests_are_whole(spark, tx_small):
    raw, root = raw_from(tx_small), scratch_path(spark, "requests")
    Q.process(raw, root, P.rule_responses, "run", 0)
    times = {r.transaction_id: r.timestamp for r in V.split(raw)[0].collect()}
    audit = A.parse_json(Q.audit(spark, root)).select("transaction_id", "payload", "created_at").collect()
    assert {r.transaction_id: r.payload.timestamp for r in audit} == times
    assert all(r.created_at - dt.datetime.now() < dt.timedelta(minutes=5) and r.payload.city for r in audit)
    pred = Q.predictions(spark, root)
    assert V.prediction_check(pred).filter(F.size("errors") > 0).count() == 0
    assert {r.transaction_id: r.event_time for r in pred.collect()} == times


def test_no_request_at_all_and_none_accepted(spark, tx_small):
    raw, root = raw_from(tx_small), scratch_path(spark, "requests")
    assert counts(spark, root, raw.schema) == (0, 0, 0, 0)
    assert Q.process(raw.limit(0), root, P.rule_responses, "run", 0)
    assert counts(spark, root, raw.schema) == (0, 0, 0, 0)
    assert Q.process(raw.withColumn("amount", F.lit("abc")), root, P.rule_responses, "run", 1)
    assert counts(spark, root, raw.schema) == (0, raw.count(), 0, 0)


def test_trained_models_answer_the_same_way(spark, tx_small):
    scorer, parts = P.train(spark, tx_small, max_iter=2, forest_trees=8)
    parts.unpersist()
    raw, root = raw_from(tx_small), scratch_path(spark, "requests")
    Q.process(raw, root, lambda df: P.responses(scorer, df), "run", 0)
    got = {r.transaction_id: (r.fraud_probability, r.anomaly_score, r.decision) for r in Q.predictions(spark, root).collect()}
    plain = P.score(scorer, V.split(raw)[0])
    assert got == {r.transaction_id: (r.fraud_probability, r.anomaly_score, r.decision) for r in plain.collect()}


# ------------------------------------------------------------------ the log

def day_rows(spark, days, n=30, id_from=0):
    rows = [(f"{id_from + d * n + k:06d}", f"t{d}_{k}", "u", "{}", 0.1, 0.2, "low", "ALLOW" if k % 3 else "BLOCK", "[]",
             dt.datetime(2026, 1, 1, 8) + dt.timedelta(days=d, minutes=k)) for d in days for k in range(n)]
    return (spark.createDataFrame(rows, "id string, transaction_id string, user_id string, request_payload string, fraud_probability double, "
                                        "anomaly_score double, risk_level string, decision string, top_reasons string, created_at timestamp")
            .withColumn("created_date", F.to_date("created_at")))


def newest_by_sort(df, n):
    return [r.id for r in df.orderBy(F.desc("created_at"), F.desc("id")).limit(n).collect()]


def test_newest_rows_open_only_the_newest_files(spark):
    path = scratch_path(spark, "log")
    every = None
    for k, days in enumerate((range(0, 10), range(10, 20), range(15, 18))):
        rows = day_rows(spark, days, id_from=10_000 * k)
        assert L.append(rows, path, f"a{k}")
        every = rows if every is None else every.unionByName(rows)
    for n in (1, 15, 30, 31, 100):
        got = L.newest(spark, path, n)
        assert [r.id for r in got.collect()] == newest_by_sort(every, n)
        assert len(got.inputFiles()) < 0.5 * len(L.read(spark, path).inputFiles())
        assert all("created_date=2026-01-1" in f or "created_date=2026-01-20" in f for f in got.inputFiles())
    assert len({f.rsplit("/", 1)[0] for f in L.newest(spark, path, 15).inputFiles()}) == 1


def test_overlapping_zones_and_few_rows(spark, monkeypatch):
    path = scratch_path(spark, "log")
    late = day_rows(spark, [3], 50).withColumn("created_at", F.to_timestamp(F.lit("2026-01-04 08:00:00")))   # all at one moment
    assert L.append(late, path, "ties") and L.append(day_rows(spark, [3, 4], 5, 900), path, "more")
    every = L.read(spark, path)
    for n in (1, 7, 20, 60, 100):
        assert [r.id for r in L.newest(spark, path, n).collect()] == newest_by_sort(every, n)
    monkeypatch.setattr(L, "MAX_FOLDERS", 1)       # too many folders to name: bounded by time instead
    for n in (7, 100):
        assert [r.id for r in L.newest(spark, path, n).collect()] == newest_by_sort(every, n)


def test_appends_are_published_once_and_whole(spark, monkeypatch):
    path = scratch_path(spark, "log")
    rows = day_rows(spark, [1, 2])
    with monkeypatch.context() as m:
        m.setattr(L, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            L.append(rows, path, "a")
    assert L.read(spark, path).count() == 0 and L.newest(spark, path, 5).count() == 0
    assert L.append(rows, path, "a") and not L.append(rows, path, "a")
    assert L.read(spark, path).count() == 60
    totals = {(str(r.created_date), r.decision): r.n for r in L.decision_totals(spark, path).collect()}
    assert totals == {("2026-01-02", "ALLOW"): 20, ("2026-01-02", "BLOCK"): 10, ("2026-01-03", "ALLOW"): 20, ("2026-01-03", "BLOCK"): 10}


def test_rows_without_a_time(spark):
    path = scratch_path(spark, "log")
    rows = day_rows(spark, [1], 4)
    none = rows.withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("created_date", F.lit(None).cast("date")).withColumn("id", F.concat("id", F.lit("x")))
    L.append(rows.unionByName(none), path, "a")
    assert len(L.newest(spark, path, 3).collect()) == 3 and L.newest(spark, path, 100).count() == 8
    assert all(r.created_at is not None for r in L.newest(spark, path, 4).collect())
    with pytest.raises(ValueError):
        L.newest(spark, path, 101)


def test_feed_log_equals_plain_sort(spark, tx_small):
    path = scratch_path(spark, "log")
    rows = A.audit_rows(P.risk_ops.assess(scored_from(tx_small)), id_col="id")
    L.append(rows, path, "feed")
    assert [r.id for r in L.newest(spark, path, 100).collect()] == [r.id for r in A.recent(rows, 100).collect()]
