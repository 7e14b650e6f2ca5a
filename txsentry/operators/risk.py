"""Risk tiering over scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsentry.functions import risk as R
from txsentry.schema import DECISIONS, DEFAULT_THRESHOLDS, RiskThresholds


def assess(df: DataFrame, t: RiskThresholds = DEFAULT_THRESHOLDS,
           p: str = "fraud_probability", a: str = "anomaly_score") -> DataFrame:
    """Add combined_score, risk_level and decision; level uses the unrounded score."""
    score = R.combined_score(p, a, t)
    return (df.withColumn("_score", score)
              .withColumns({"combined_score": F.round("_score", 6),
                            "risk_level": R.risk_level("_score", t)})
              .withColumn("decision", R.decision("risk_level"))
              .drop("_score"))


def decision_counts(df: DataFrame) -> DataFrame:
    """Rows per decision, all three decisions present (zero when absent).

    One partial aggregate of three conditional counts, unpivoted: no join
    and no driver-side vocabulary table.
    """
    counts = df.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS])
    pairs = ", ".join(f"'{d}', `{d}`" for d in DECISIONS)
    return counts.selectExpr(f"stack({len(DECISIONS)}, {pairs}) AS (decision, n)")


def binary_decisions(df: DataFrame, weight_p: float = 0.7, weight_a: float = 0.3,
                     threshold: float = 0.5) -> DataFrame:
    return df.withColumn("decision", R.binary_decision(
        "fraud_probability", "anomaly_score", weight_p, weight_a, threshold))
