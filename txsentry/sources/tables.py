"""Driver tables and the transaction-shaped views derived from them.

The driver ships TPC-H-like tables plus an ``events`` stream.  ``events``
carries users, event time and a value; ``customer`` carries a nation per
user.  The views below give them the shape of a payment feed:

* ``transactions``      labelled feed (13 request fields + ``is_fraud``)
* ``raw_transactions``  the same as raw request text, with dirty rows
* ``scored``            deterministic stand-in model scores (no model needed)
* ``geo_dim``           the (country, city) reference list

All are lazy DataFrames: filters and projections of callers reach the
Parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentry.schema import COUNTRIES, MERCHANT_CATEGORIES

# Fixed values of the feed derivation: devices and channels by user_id % 4.
_FEED_DEVICES = ["mobile", "desktop", "tablet", "pos_terminal"]
_FEED_CHANNELS = ["mobile_app", "online", "mobile_app", "in_store"]
_FEED_TYPES = {"purchase": "purchase", "click": "payment", "view": "transfer",
               "signup": "refund"}  # anything else: withdrawal


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; ``TIMESTAMP_NTZ`` columns become session-zone TIMESTAMP."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    casts = {f.name: F.col(f.name).cast("timestamp")
             for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def _pick(values: list[str], one_based_index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), one_based_index.cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled transaction feed, one row per event (3.5% fraud)."""
    return transactions_from(read_table(spark, sf_dir, "events"),
                             read_table(spark, sf_dir, "customer"))


def transactions_from(ev: DataFrame, customer: DataFrame) -> DataFrame:
    """The feed from an events table or stream and the customer table (a
    stream-static inner join when ``ev`` is a stream)."""
    cust = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nk"))
    # Inner equi-join on the customer key: customer grows with the data, so
    # no forced broadcast; AQE broadcasts it at run time when it is small.
    t = ev.join(cust, "user_id").withColumn("dev", (F.col("event_id") * 7919 + 13) % 1000)
    eid, uid, dev = F.col("event_id"), F.col("user_id"), F.col("dev")
    fraud = dev < 35
    abroad = fraud & (dev % 3 == 0)
    ttype = F.coalesce(F.create_map(*[F.lit(x) for kv in _FEED_TYPES.items() for x in kv])
                       [F.col("event_type")], F.lit("withdrawal"))
    cat_idx = F.when(fraud | (eid % 20 == 0), (uid + eid) % 10).otherwise((uid + 3 * (eid % 2)) % 10)
    return t.select(
        F.concat(F.lit("tx_"), eid.cast("string")).alias("transaction_id"),
        F.concat(F.lit("user_"), uid.cast("string")).alias("user_id"),
        F.concat(F.lit("mrc_"), ((eid * 31) % 100).cast("string")).alias("merchant_id"),
        F.round(F.col("value") * F.when(fraud, 400).otherwise(50), 2).alias("amount"),
        ttype.alias("transaction_type"),
        _pick(MERCHANT_CATEGORIES, 1 + cat_idx).alias("merchant_category"),
        F.when(fraud & (dev % 2 == 0), "unknown").when(eid % 20 == 1, "tablet")
         .otherwise(_pick(_FEED_DEVICES, 1 + uid % 4)).alias("device_type"),
        F.when(fraud, "online").otherwise(_pick(_FEED_CHANNELS, 1 + uid % 4)).alias("channel"),
        F.when(abroad, "Offshore City")
         .otherwise(F.concat(F.lit("City_"), ((uid + eid) % 2).cast("string"))).alias("city"),
        _pick(COUNTRIES, 1 + (F.col("nk") + abroad.cast("int")) % 10).alias("country"),
        F.col("ts").alias("timestamp"),
        abroad.alias("is_international"),
        (~fraud & (uid % 4 == 3)).alias("card_present"),
        fraud.cast("int").alias("is_fraud"),
    )


def tx_number(tx_id: Column) -> Column:
    """Numeric part of ``tx_<n>`` ids."""
    return F.substring(tx_id, 4, 1 << 20).cast("bigint")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as raw request text with missing, malformed and out-of-domain values."""
    return raw_from(transactions(spark, sf_dir))


def raw_from(tx: DataFrame) -> DataFrame:
    t = tx.withColumn("n", tx_number(F.col("transaction_id")))
    n = F.col("n")
    return t.select(
        "transaction_id",
        F.when(n % 50 == 17, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
        "merchant_id",
        F.when(n % 50 == 7, "-50.0").when(n % 50 == 23, "abc")
         .otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(n % 50 == 11, "gambling").otherwise(F.col("transaction_type")).alias("transaction_type"),
        F.when(n % 50 == 29, "food").otherwise(F.col("merchant_category")).alias("merchant_category"),
        F.when(n % 10 == 3, F.lit(None)).otherwise(F.col("device_type")).alias("device_type"),
        "channel", "city",
        F.when(n % 50 == 13, "USA").when(n % 3 == 0, F.lower("country"))
         .otherwise(F.col("country")).alias("country"),
        F.when(n % 50 == 19, "junk")
         .otherwise(F.date_trunc("second", "timestamp").cast("string")).alias("timestamp"),
        F.when(n % 10 == 4, F.lit(None)).when(F.col("is_international"), "True")
         .otherwise("false").alias("is_international"),
        F.when(n % 10 == 5, F.lit(None)).when(F.col("card_present"), "true")
         .otherwise("False").alias("card_present"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with deterministic stand-in scores, an id and a created_at."""
    return scored_from(transactions(spark, sf_dir))


def scored_from(tx: DataFrame) -> DataFrame:
    t = tx.withColumn("n", tx_number(F.col("transaction_id")))
    n = F.col("n")
    return t.select(
        "*",
        (((n * 37) % 1000).cast("double") / 1000 * F.lit(0.7)
         + F.col("is_fraud") * F.lit(0.3)).alias("fraud_probability"),
        (((n * 91) % 1000).cast("double") / 1000).alias("anomaly_score"),
        F.date_trunc("second", "timestamp").alias("created_at"),
        n.alias("id"),
    ).drop("n")


def geo_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known (country, city) pairs: each country seen in the feed with its two cities."""
    countries = transactions(spark, sf_dir).select("country").distinct()
    cities = F.explode(F.array(F.lit("City_0"), F.lit("City_1"))).alias("city")
    return countries.select("country", cities)
