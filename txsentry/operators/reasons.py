"""Explanations over scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsentry.functions import reasons as X


def with_top_reasons(df: DataFrame, k: int = X.TOP_K) -> DataFrame:
    return df.withColumn("top_reasons", X.top_reasons(X.all_reasons(), k))


def reason_rows(df: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """One row per (transaction, rank) of ``top_reasons`` (rank from 1)."""
    return df.select(id_col, F.posexplode("top_reasons").alias("pos", "r")).select(
        id_col, (F.col("pos") + 1).alias("rank"), "r.feature", "r.contribution", "r.direction")


def reason_frequency(df: DataFrame) -> DataFrame:
    """How often each reason reaches the top list, and its mean contribution."""
    rows = df.select(F.explode("top_reasons").alias("r"))
    return (rows.groupBy(F.col("r.feature").alias("feature"), F.col("r.direction").alias("direction"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg("r.contribution"), 6).alias("mean_contribution")))


def reason_display(rows: DataFrame) -> DataFrame:
    """Display fields of reason rows: label, whole percent and its band."""
    pct = X.percent(F.col("contribution"))
    return rows.withColumns({"label": X.display_label(F.col("feature")), "percent": pct}) \
               .withColumn("band", X.percent_band(F.col("percent")))


def probability_display(df: DataFrame) -> DataFrame:
    p = F.col("fraud_probability")
    return df.withColumns({"probability_pct": F.round(p * 100, 1),
                           "probability_band": X.probability_band(p)})
