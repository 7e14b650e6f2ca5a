"""Distributed label dictionaries: codes, large dictionaries, hot labels, persistence."""

import pytest
from pyspark.sql import functions as F

from txsentry.operators import labels as L
from txsentry.operators.features import FeatureEncoder, FeatureModel
from txsentry.schema import CATEGORICAL_COLS
from txsentry.session import scratch_path


def words(spark, n, hot=0):
    """n distinct labels in column a, three in b; ``hot`` further rows of one label."""
    df = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 12).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    return df.unionByName(spark.range(hot).select(F.lit("hot é").alias("a"), F.lit(None).cast("string").alias("b"))) if hot else df


def test_codes_are_sorted_positions(spark):
    df = words(spark, 5000, hot=3000).repartition(7)
    got = {(r.column, r.label): (r.code, r.n) for r in L.rank_labels(df, ["a", "b"]).collect()}
    for c in ("a", "b"):
        labels = sorted({r[c].encode() for r in df.select(c).collect() if r[c] is not None})
        assert [got[c, x.decode()][0] for x in labels] == list(range(len(labels)))
    assert got["a", "hot é"][1] == 3000 and got["b", "0"][1] == 1667
    assert len(got) == 5001 + 3


@pytest.mark.parametrize("limit", [L.BROADCAST_BYTES, 0])
def test_large_dictionaries_give_the_same_codes(spark, limit):
    df, path = words(spark, 4000, hot=2000), scratch_path(spark, "labels")
    sizes = L.fit(df, ["a", "b"], path)
    assert sizes["a"]["labels"] == 4001 and sizes["a"]["rows"] == 6000
    new = df.unionByName(spark.createDataFrame([("unseen", "9"), (None, None)], "a string, b string")).withColumn("keep", F.col("a"))
    got = L.encode(new.repartition(5), path, sizes, broadcast_bytes=limit)
    assert got.columns == ["a", "b", "keep"] and got.count() == 6002
    code = {r.label: r.code for r in L.read(spark, path).filter("column = 'a'").collect()}
    assert all(r.a == code.get(r.keep, -1) for r in got.collect())
    assert got.filter("keep = 'unseen' OR keep IS NULL").select("a").distinct().collect()[0].a == L.UNSEEN


def test_a_million_labels(spark):
    df = words(spark, 1_000_000)
    path = scratch_path(spark, "labels")
    sizes = L.fit(df, ["a"], path)
    assert sizes["a"]["labels"] == 1_000_000 and sizes["a"]["bytes"] > L.BROADCAST_BYTES
    got = L.encode(df, path, sizes)
    assert got.agg(F.countDistinct("a"), F.min("a"), F.max("a")).first()[:] == (1_000_000, 0, 999_999)


def test_no_rows_and_all_null(spark):
    path = scratch_path(spark, "labels")
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    sizes = L.fit(df, ["a", "b"], path)
    assert sizes["a"]["labels"] == 0 and L.encode(df, path, sizes).first()[:] == (-1, 0)


def test_encoder_keeps_its_dictionary(spark, tx_small):
    model = FeatureEncoder().fit(tx_small)
    path = scratch_path(spark, "encoder")
    model.write().overwrite().save(path)
    back = FeatureModel.load(path)
    assert back.getOrDefault(back.dictionary).startswith(path)
    a, b = (sorted(map(str, m.feature_columns(tx_small).collect())) for m in (model, back))
    assert a == b
    unseen = model.feature_columns(tx_small.withColumn("channel", F.lit("carrier pigeon"))).select("channel").distinct().collect()
    assert [r.channel for r in unseen] == [-1.0]
    assert {r.column for r in model.label_table(spark).collect()} == set(CATEGORICAL_COLS)
