"""Registered dataset-preparation (D1-D6) and profiling (P1-P5) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from txsentry.operators import prepare as D
from txsentry.operators import profile as P
from txsentry.plans.catalog import query
from txsentry.plans.oracle import sround, with_views
from txsentry.sources.tables import transactions, tx_number

_P = 2147483647
_KEY_SQL = (f"((((((CAST(substr(transaction_id, 4) AS BIGINT) % {_P}) + 42) % {_P}) * 48271) % {_P}"
            f" + {42 * 7919}) % {_P} * 48271) % {_P}")


def _tx(spark, sf_dir):
    return transactions(spark, sf_dir)


def _nid():
    return tx_number(F.col("transaction_id"))


@query("union_labelled", with_views("""
SELECT transaction_id, user_id, is_fraud FROM transactions WHERE is_fraud = 0
UNION ALL
SELECT transaction_id, user_id, is_fraud FROM transactions WHERE is_fraud = 1"""))
def q_union_labelled(spark, sf_dir):
    t = _tx(spark, sf_dir)
    normal = t.filter(F.col("is_fraud") == 0)
    fraud = t.filter(F.col("is_fraud") == 1)
    return D.union_labelled(normal, fraud).select("transaction_id", "user_id", "is_fraud")


@query("shuffle_rows", with_views(f"SELECT transaction_id, {_KEY_SQL} AS shuffle_key FROM transactions"))
def q_shuffle_rows(spark, sf_dir):
    return D.shuffle_rows(_tx(spark, sf_dir), 42, _nid()).select("transaction_id", "shuffle_key")


@query("sample_n", with_views(f"""
SELECT transaction_id, {_KEY_SQL} AS shuffle_key FROM transactions
ORDER BY shuffle_key LIMIT 500"""))
def q_sample_n(spark, sf_dir):
    return D.sample_n(_tx(spark, sf_dir), 500, 42, _nid()).select("transaction_id", "shuffle_key")


@query("stratified_split", with_views(f"""
SELECT transaction_id, is_fraud,
  CAST(row_number() OVER (PARTITION BY is_fraud ORDER BY {_KEY_SQL}, transaction_id)
       <= ceil(0.2 * count(*) OVER (PARTITION BY is_fraud)) AS INT) AS is_test
FROM transactions"""))
def q_stratified_split(spark, sf_dir):
    return D.stratified_split(_tx(spark, sf_dir), numeric_id=_nid()).select(
        "transaction_id", "is_fraud", "is_test")


@query("enforce_types", with_views("""
SELECT transaction_id, user_id, round(amount, 2) AS amount, transaction_type, merchant_category,
  merchant_id, device_type, channel, city, country,
  strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
  coalesce(is_international, false) AS is_international,
  coalesce(card_present, false) AS card_present, CAST(is_fraud AS INT) AS is_fraud
FROM transactions"""))
def q_enforce_types(spark, sf_dir):
    out = D.enforce_types(_tx(spark, sf_dir))
    return out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("class_weights", with_views(f"""
SELECT is_fraud, n, {sround('sum(n) OVER () / (2.0 * n)', 6)} AS balanced_weight,
  CASE WHEN is_fraud = 1 THEN 10.0 ELSE 1.0 END::DOUBLE AS scale_weight
FROM (SELECT is_fraud, count(*) AS n FROM transactions GROUP BY is_fraud) c"""))
def q_class_weights(spark, sf_dir):
    w = D.class_weights(_tx(spark, sf_dir))
    return w.withColumn("balanced_weight", F.round("balanced_weight", 6))


@query("dataset_overview", with_views(f"""
SELECT count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
  {sround('avg(is_fraud) * 100', 2)} AS fraud_pct, count(DISTINCT user_id) AS n_users,
  strftime(min(timestamp), '%Y-%m-%d') AS first_date, strftime(max(timestamp), '%Y-%m-%d') AS last_date
FROM transactions"""))
def q_dataset_overview(spark, sf_dir):
    return P.dataset_overview(_tx(spark, sf_dir))


@query("amount_by_label", with_views(f"""
SELECT is_fraud, {sround('min(amount)', 2)} AS min_amount, {sround('avg(amount)', 2)} AS mean_amount,
  {sround('max(amount)', 2)} AS max_amount, {sround('median(amount)', 2)} AS median_amount
FROM transactions GROUP BY is_fraud"""))
def q_amount_by_label(spark, sf_dir):
    return P.amount_by_label(_tx(spark, sf_dir))


@query("night_rate_by_label", with_views(f"""
SELECT is_fraud, {sround('avg(CAST(hour(timestamp) >= 22 OR hour(timestamp) < 6 AS INT))', 3)}
  AS night_rate
FROM transactions GROUP BY is_fraud"""))
def q_night_rate_by_label(spark, sf_dir):
    return P.night_rate_by_label(_tx(spark, sf_dir))


@query("intl_rate_by_label", with_views(f"""
SELECT is_fraud, {sround('avg(CAST(coalesce(is_international, false) AS INT))', 3)} AS intl_rate
FROM transactions GROUP BY is_fraud"""))
def q_intl_rate_by_label(spark, sf_dir):
    return P.intl_rate_by_label(_tx(spark, sf_dir))


@query("fraud_ratio", with_views(f"""
SELECT {sround('avg(is_fraud)', 4)} AS fraud_ratio FROM transactions"""))
def q_fraud_ratio(spark, sf_dir):
    return P.fraud_ratio(_tx(spark, sf_dir))
