"""Null labels, amounts and categories; boolean flags through CSV; sinks of a second run."""

import statistics

from sf_paths import SF_SMALL
from pyspark.sql import functions as F

from txsentry.operators import behaviour as B
from txsentry.operators import models as M
from txsentry.operators import prepare as D
from txsentry.operators import profile as P
from txsentry.operators import stats as ST
from txsentry.session import scratch_path
from txsentry.sources import files as S
from txsentry.sources.tables import scored_from
from txsentry.streaming import jobs as T


def test_exact_median_with_nulls_and_a_frequent_value(spark):
    values = {1: [1.0, 2.0, 3.0, None, None], None: [5.0] * 30 + [1.0, 9.0], 0: [4.0, 8.0], 2: [None]}
    rows = [(k, v) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    got = {r.g: r["median"] for r in ST.exact_median(df, ["g"], "v").collect()}
    assert got == {k: statistics.median([v for v in vs if v is not None]) for k, vs in values.items() if any(vs)}


def test_null_labels_are_kept(spark, tx_small):
    df = tx_small.withColumn("is_fraud", F.when(F.abs(F.hash("transaction_id")) % 10 > 0, F.col("is_fraud")))
    n, unlabelled = df.count(), df.filter("is_fraud IS NULL").count()
    assert unlabelled > 0
    parts = D.stratified_split(df)
    assert parts.count() == n
    assert parts.filter("is_fraud IS NULL AND is_test = 1").count() == -(-unlabelled // 5)
    weighted = D.with_weights(df)
    assert weighted.count() == n and weighted.filter("weight IS NULL").count() == unlabelled
    assert P.amount_by_label(df).filter("median_amount IS NOT NULL").count() == 3
    from txsentry.operators.features import FeatureEncoder
    model = FeatureEncoder(keepCols=["is_fraud"]).fit(df)
    assert M.train_gbt(model.transform(df), max_iter=1).getNumTrees == 1


def test_signals_keep_rows_with_a_null_category(tx_small):
    df = tx_small.withColumn("merchant_category", F.when(F.col("amount") > 50, F.col("merchant_category")))
    sig = B.signals(df)
    assert sig.count() == df.count()
    assert B.deviation_count(sig).filter("flagged IS NULL").count() == 0


def test_boolean_flags_survive_the_labelled_file(spark, tx_small):
    path = scratch_path(spark, "labelled")
    typed = D.enforce_types(tx_small)
    assert {dict(typed.dtypes)[c] for c in ("is_international", "card_present")} == {"boolean"}
    S.write_labelled_csv(typed, path)
    cols = ["transaction_id", "is_international", "card_present"]
    assert sorted(S.read_labelled_csv(spark, path).select(cols).collect()) == sorted(typed.select(cols).collect())


def test_audit_rows_of_an_earlier_run_stay(spark):
    path = scratch_path(spark, "audit-runs")
    pred = scored_from(T.transactions_stream(spark, SF_SMALL))
    for k in (1, 2):
        T.audit_to_table(pred, path, scratch_path(spark, f"ck-run{k}")).awaitTermination()
        rows = spark.read.parquet(path)
        assert rows.count() == k * 1000 and rows.select("id").distinct().count() == k * 1000
