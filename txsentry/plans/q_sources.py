"""Registered source/sink queries (S1, S2, S4, S6): each writes the feed
(or a model fitted on it) to the shared work folder and reads it back."""

from __future__ import annotations

import os

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from txsentry.operators.features import FeatureEncoder
from txsentry.plans.catalog import query
from txsentry.plans.oracle import with_views
from txsentry.plans.q_features import _FIT_ALL, _LABELS_SQL, _MATRIX_SQL, _STATS_SQL, \
    _TYPED_BASE, _encoded_sql
from txsentry.schema import FEATURE_COLUMNS
from txsentry.session import scratch_path
from txsentry.sources import files as S
from txsentry.sources.tables import transactions

_ROUND_TRIP_SQL = with_views("""
SELECT transaction_id, amount, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
  CAST(is_international AS INT) AS is_international, CAST(card_present AS INT) AS card_present,
  is_fraud, country, device_type
FROM transactions""")


def _round_trip_cols(df):
    return df.select("transaction_id", "amount",
                     F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
                     F.col("is_international").cast("int").alias("is_international"),
                     F.col("card_present").cast("int").alias("card_present"),
                     "is_fraud", "country", "device_type")


@query("scan_csv", _ROUND_TRIP_SQL)
def q_scan_csv(spark, sf_dir):
    folder = scratch_path(spark, "csv")
    S.write_labelled_csv(transactions(spark, sf_dir), os.path.join(folder, "transactions.csv"))
    # The refined v2 file is preferred when present; here only v1 exists.
    back = S.read_labelled_csv(spark, [os.path.join(folder, "transactions_v2.csv"),
                                       os.path.join(folder, "transactions.csv")])
    return _round_trip_cols(back)


@query("scan_json", _ROUND_TRIP_SQL)
def q_scan_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    S.write_transactions_json(transactions(spark, sf_dir), path)
    return _round_trip_cols(S.read_transactions_json(spark, path, labelled=True))


@query("sink_csv", with_views("""
SELECT transaction_id, user_id, merchant_category, CAST(is_fraud AS VARCHAR) AS is_fraud
FROM transactions"""))
def q_sink_csv(spark, sf_dir):
    path = scratch_path(spark, "sink")
    S.write_labelled_csv(transactions(spark, sf_dir), path)
    # Read without a schema: every column as text, names from the header.
    back = spark.read.option("header", "true").csv(path)
    return back.select("transaction_id", "user_id", "merchant_category", "is_fraud")


@query("model_io", with_views(_MATRIX_SQL, _TYPED_BASE, _FIT_ALL, _LABELS_SQL, _STATS_SQL,
                              _encoded_sql()))
def q_model_io(spark, sf_dir):
    t = transactions(spark, sf_dir)
    model = Pipeline(stages=[FeatureEncoder()]).fit(t)
    path = scratch_path(spark, "model")
    S.save_model(model, path)
    loaded = S.load_model(path)
    out = loaded.transform(t)
    return out.select("transaction_id", *[F.round(c, 6).alias(c) for c in FEATURE_COLUMNS])


@query("sink_metadata", with_views("""
SELECT count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
  count(DISTINCT user_id) AS n_users FROM transactions"""))
def q_sink_metadata(spark, sf_dir):
    from txsentry.operators.profile import dataset_overview
    # A run summary computed by Spark, persisted as one JSON document and read back.
    meta = dataset_overview(transactions(spark, sf_dir)).first().asDict()
    back = S.write_metadata(spark, meta, scratch_path(spark, "metadata"))
    return back.select("n_rows", "n_fraud", "n_users")
