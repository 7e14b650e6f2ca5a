"""Dataset profiling aggregations (P1-P5).  All are partial (map-side)
aggregations except the exact median, which selects ranks by narrowing
intervals (``txsentry.operators.stats``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsentry.functions.features import event_hour, is_night
from txsentry.operators.stats import exact_median


def dataset_overview(df: DataFrame, approx_users: bool = False) -> DataFrame:
    users = (F.approx_count_distinct("user_id") if approx_users
             else F.countDistinct("user_id"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("is_fraud").cast("bigint").alias("n_fraud"),
        F.round(F.avg("is_fraud") * 100, 2).alias("fraud_pct"),
        users.alias("n_users"),
        F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("last_date"))


def amount_by_label(df: DataFrame, approx_median: bool = False) -> DataFrame:
    """Extremes, mean and median of the amount per label: two reads of ``df``
    for the exact median (``stats.exact_median``), one for the approximate one."""
    stats = (F.round(F.min("amount"), 2).alias("min_amount"), F.round(F.avg("amount"), 2).alias("mean_amount"),
             F.round(F.max("amount"), 2).alias("max_amount"))
    if approx_median:
        out = df.groupBy("is_fraud").agg(*stats, F.percentile_approx("amount", 0.5, 100000).alias("median"))
    else:
        out = exact_median(df, ["is_fraud"], "amount", stats)
    return out.withColumn("median_amount", F.round(F.col("median").cast("double"), 2)).drop("median")


def night_rate_by_label(df: DataFrame) -> DataFrame:
    night = is_night(event_hour(F.col("timestamp")))
    return df.groupBy("is_fraud").agg(F.round(F.avg(night), 3).alias("night_rate"))


def intl_rate_by_label(df: DataFrame) -> DataFrame:
    intl = F.coalesce(F.col("is_international").cast("int"), F.lit(0))
    return df.groupBy("is_fraud").agg(F.round(F.avg(intl), 3).alias("intl_rate"))


def fraud_ratio(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.avg("is_fraud"), 4).alias("fraud_ratio"))
