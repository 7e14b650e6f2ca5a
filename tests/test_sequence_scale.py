"""Sequence operators over buckets narrower than their window or horizon, and null keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from txsentry.operators import behaviour as B
from txsentry.operators import sequence as S

T0 = dt.datetime(2026, 3, 1)


def feed(spark, users=("hot", "u2", None), n=500, seed=1, step=900):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        user = users[0] if rng.random() < 0.7 else rng.choice(users)
        at = T0 + dt.timedelta(seconds=rng.choice([0, rng.randrange(n * step // 10), rng.randrange(n * step)]), microseconds=rng.choice([0, 1, 7]))
        rows.append((f"t{k}", user, None if rng.random() < 0.02 else at, rng.choice(["US", "DE", None]), rng.choice(["m1", "m2", "m3", None]), 1.25 * k))
    return spark.createDataFrame(rows, "transaction_id string, user_id string, timestamp timestamp, country string, merchant_id string, amount double").repartition(5)


def micros(t):
    return None if t is None else round((t - T0).total_seconds() * 1e6)


@pytest.mark.parametrize("window,bucket", [(21600, 600), (3600, 59), (3600, 7200), (86400, 21600)])
def test_trailing_count_at_any_bucket_width(spark, window, bucket):
    df = feed(spark)
    rows = df.collect()
    want = {}
    for r in rows:
        same = [micros(x.timestamp) for x in rows if x.user_id == r.user_id]
        m = micros(r.timestamp)
        want[r.transaction_id] = sum(x is None for x in same) if m is None else sum(x is not None and m - window * 1_000_000 <= x <= m for x in same)
    got = S.trailing_count(df, "user_id", "timestamp", window, "n", bucket)
    assert set(got.columns) == {*df.columns, "n"}
    assert {r.transaction_id: r.n for r in got.collect()} == want


def test_trailing_count_prefixes_over_many_buckets(spark, monkeypatch):
    df = feed(spark, n=500)
    want = {r.transaction_id: r.n for r in S.trailing_count(df, "user_id", "timestamp", 50_000, "n", 86_400 * 30).collect()}
    monkeypatch.setattr(S, "SUPER_BUCKETS", 4)
    assert {r.transaction_id: r.n for r in S.trailing_count(df, "user_id", "timestamp", 50_000, "n", 100).collect()} == want


@pytest.mark.parametrize("horizon,bucket", [(86400, 21600), (86400, 3600), (5000, 600), (3600, 3600)])
def test_lag_within_a_horizon_of_many_buckets(spark, horizon, bucket):
    df = feed(spark, seed=3)
    rows = [r for r in df.collect() if r.timestamp is not None]
    want = {}
    for r in rows:
        before = [x for x in rows if x.user_id == r.user_id and (x.timestamp, x.transaction_id) < (r.timestamp, r.transaction_id)]
        p = max(before, key=lambda x: (x.timestamp, x.transaction_id), default=None)
        near = p is not None and micros(r.timestamp) - micros(p.timestamp) <= horizon * 1_000_000
        want[r.transaction_id] = (p.timestamp, p.country) if near else (None, None)
    got = S.lag_within(df, "user_id", "timestamp", "transaction_id", ["country"], horizon, bucket)
    assert got.count() == df.count()
    assert {r.transaction_id: (r.prev_timestamp, r.prev_country) for r in got.filter("timestamp IS NOT NULL").collect()} == want


def test_one_user_with_all_rows_gives_bounded_windows(spark):
    """The largest (user, bucket) group of both halves of the count stays small."""
    df = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("transaction_id"), F.lit("hot").alias("user_id"),
                                    F.timestamp_seconds(F.col("id") * 30).alias("timestamp"))
    got = S.trailing_count(df, "user_id", "timestamp", 21600, "n", 600)
    assert got.agg(F.max("n"), F.min("n"), F.count("*")).first()[:] == (721, 1, 20_000)
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_sessions_count_values_without_lists(spark):
    df = feed(spark, seed=5, step=60).filter("timestamp IS NOT NULL")
    got = S.session_summaries(df, "user_id", "timestamp", "transaction_id", 240, "amount", "merchant_id", 300)
    plan = got._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    want, rows = {}, sorted(df.collect(), key=lambda r: (str(r.user_id), r.timestamp, r.transaction_id))
    last = None
    for r in rows:
        if last is None or last.user_id != r.user_id or micros(r.timestamp) - micros(last.timestamp) > 240_000_000:
            start = (r.user_id, r.timestamp)
            want[start] = [0, set(), 0.0, r.timestamp]
        w = want[start]
        w[0], w[2], w[3] = w[0] + 1, w[2] + r.amount, r.timestamp
        w[1] |= {r.merchant_id} - {None}
        last = r
    assert {(r.user_id, r.session_start): [r.n_tx, r.n_distinct, round(r.total, 6), r.session_end] for r in got.collect()} == \
        {k: [v[0], len(v[1]), round(v[2], 6), v[3]] for k, v in want.items()}


def test_missing_categories_are_one_rule(spark):
    rows = [(f"t{k}", "u1", None, "US", "mobile", 1.0) for k in range(3)] + [("a", "u2", "x", "US", "mobile", 1.0), ("b", None, "x", "US", "mobile", 1.0)]
    tx = spark.createDataFrame(rows, "transaction_id string, user_id string, merchant_category string, country string, device_type string, amount double") \
              .withColumn("timestamp", F.lit(T0)).withColumn("transaction_type", F.lit("purchase"))
    flagged = {r.transaction_id for r in B.unusual_merchant(tx, B.user_top_values(tx, "merchant_category", 3)).collect()}
    signalled = {r.transaction_id for r in B.signals(tx).filter("sig_merchant = 1").collect()}
    assert flagged == signalled == set()


def test_profile_rolled_up_from_one_aggregate(spark, tx_small):
    odd = tx_small.withColumn("country", F.when(F.col("amount") > 50, F.col("country"))).withColumn(
        "device_type", F.when(F.crc32("transaction_id") % 3 > 0, F.col("device_type")))
    got = {(r.user_id, r.merchant_category): (r.home_country, r.primary_device, round(r.avg_amount, 9), r.n_tx) for r in B.profile_by_category(odd).collect()}
    plain = {r.user_id: (r.home_country, r.primary_device, round(r.avg_amount, 9), r.n_tx) for r in B.user_profile(odd).collect()}
    assert {k: plain[k[0]] for k in got} == got
    scans = B.signals(tx_small)._jdf.queryExecution().executedPlan().toString().count("events.parquet")
    assert scans <= 2
