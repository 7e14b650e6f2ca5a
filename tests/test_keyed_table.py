"""The keyed table: one row per key, everything else kept with its reason."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from txsentry.operators import audit as A
from txsentry.operators import audit_log as L
from txsentry.operators import keyed_table as K
from txsentry.session import scratch_path

SCHEMA = "k string, v int, t timestamp"


def rows(spark, *triples):
    return spark.createDataFrame([(k, v, t) for k, v, t in triples], "k string, v int, t int").withColumn("t", F.timestamp_seconds("t")).repartition(3)


def state(spark, path, schema):
    return (sorted((r.k, r.v) for r in K.read(spark, path, schema).collect()),
            Counter((r.k, r.v, r.reason) for r in K.quarantine(spark, path, schema).collect()))


def test_insert_and_quarantine(spark):
    path = scratch_path(spark, "keyed")
    first = rows(spark, ("a", 1, 10), ("a", 2, 20), ("a", 2, 20), ("b", 3, None), (None, 4, 5), (None, 4, 5), ("", 5, 1))
    assert K.insert(first, path, "one", "k", "t", buckets=4)
    assert state(spark, path, first.schema) == (
        [("", 5), ("a", 2), ("b", 3)],
        Counter({("a", 1, K.REPEATED): 1, ("a", 2, K.REPEATED): 1, (None, 4, K.MISSING): 2}))
    before = state(spark, path, first.schema)
    assert not K.insert(first, path, "one", "k", "t", buckets=4) and state(spark, path, first.schema) == before
    again = rows(spark, ("a", 9, 99), ("c", 7, 1), (None, 8, 1))
    assert K.insert(again, path, "two", "k", "t", buckets=4)
    stored, refused = state(spark, path, first.schema)
    assert stored == [("", 5), ("a", 2), ("b", 3), ("c", 7)]
    assert refused - before[1] == Counter({("a", 9, K.STORED): 1, (None, 8, K.MISSING): 1})
    assert {r.outcome: r.n for r in K.counts(spark, path).collect()} == {"stored": 4, K.REPEATED: 2, K.MISSING: 3, K.STORED: 1}
    assert [r.v for r in K.lookup(spark, path, first.schema, "c", "k", buckets=4).collect()] == [7]
    assert K.lookup(spark, path, first.schema, "zz", "k", buckets=4).count() == 0


def test_a_failed_insert_is_invisible_and_can_be_repeated(spark, monkeypatch):
    path = scratch_path(spark, "keyed")
    df = rows(spark, ("a", 1, 1), ("a", 0, 0), ("b", 2, 2))
    with monkeypatch.context() as m:
        m.setattr(L, "manifest_path", lambda p: (_ for _ in ()).throw(OSError("gone")) if m.armed else p + "-manifest", raising=True)
        m.armed = False
        published = L.is_published
        m.setattr(L, "is_published", lambda *a: (published(*a), setattr(m, "armed", True))[0])
        with pytest.raises(OSError):
            K.insert(df, path, "one", "k", "t")
    assert L.exists(spark, path) and state(spark, path, df.schema) == ([], Counter())
    assert K.insert(df, path, "one", "k", "t")
    assert state(spark, path, df.schema) == ([("a", 1), ("b", 2)], Counter({("a", 0, K.REPEATED): 1}))


def test_only_touched_buckets_are_read(spark):
    path = scratch_path(spark, "keyed")
    many = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("v"), F.timestamp_seconds("id").alias("t"))
    K.insert(many, path, "many", "k", "t", buckets=16)
    read = K.read(spark, path, many.schema)
    plan = read.filter(F.col("bucket").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    K.insert(many.limit(3), path, "few", "k", "t", buckets=16)
    assert read.count() == 500 and K.quarantine(spark, path, many.schema).count() == 3


def test_no_new_rows_and_none_at_all(spark):
    path = scratch_path(spark, "keyed")
    df = rows(spark, (None, 1, 1))
    assert K.insert(df.limit(0), path, "none", "k", "t") and K.insert(df, path, "nameless", "k", "t")
    assert state(spark, path, df.schema) == ([], Counter({(None, 1, K.MISSING): 1}))


def test_stored_null_keys_are_not_inserted_again(spark):
    new = spark.createDataFrame([(None, 1), ("a", 2), ("a", 1), ("b", 1)], "transaction_id string, created_at int")
    insert, refused = A.keyed_store(new, spark.createDataFrame([(None,), ("b",)], "transaction_id string"))
    assert [(r.transaction_id, r.created_at) for r in insert.collect()] == [("a", 2)]
    assert Counter((r.transaction_id, r.created_at) for r in refused.collect()) == Counter([(None, 1), ("a", 1), ("b", 1)])


def test_a_batch_is_computed_once(spark):
    path, seen = scratch_path(spark, "keyed"), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(v):
        seen.add(1)
        return v

    first = rows(spark, ("a", 1, 1), ("b", 2, 2))
    K.insert(first, path, "one", "k", "t", buckets=4)
    K.insert(rows(spark, ("a", 9, 9), ("c", 3, 3), (None, 4, 4)).withColumn("v", counted("v")), path, "two", "k", "t", buckets=4)
    assert seen.value == 3
    assert state(spark, path, first.schema) == ([("a", 1), ("b", 2), ("c", 3)], Counter({("a", 9, K.STORED): 1, (None, 4, K.MISSING): 1}))


def test_the_keyed_query_predicts_the_feed_once(spark, monkeypatch):
    from txsentry.plans import q_audit
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    n = 40
    feed = spark.range(n).select(
        F.concat(F.lit("tx_"), "id").alias("transaction_id"), F.lit("u").alias("user_id"), F.col("id").cast("double").alias("amount"),
        F.lit(0.5).alias("combined_score"), F.element_at(F.array(*map(F.lit, ("ALLOW", "REVIEW", "BLOCK"))), (F.col("id") % 3 + 1).cast("int")).alias("decision"),
        F.array(F.lit("r")).alias("top_reasons"), F.timestamp_seconds("id").alias("created_at")).withColumn("user_id", counted("user_id"))
    monkeypatch.setattr(q_audit, "_predictions", lambda spark, sf_dir: feed)
    got = Counter(r.outcome for r in q_audit.q_keyed_store(spark, "unused").collect())
    assert got == {"stored": 40, K.STORED: 13, K.REPEATED: 13, K.MISSING: 13} and seen.value == n
