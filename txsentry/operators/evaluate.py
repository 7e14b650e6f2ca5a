"""Model evaluation (Q1-Q6): exact metrics from aggregates.

Every metric is computed from conditional counts (one partial aggregate)
except ROC AUC, which needs the rank of each score: scores are first
reduced to one row per distinct score (positive and negative counts,
map-side), then a distributed prefix sum gives the negatives below each
score; ties count one half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsentry.operators.stats import prefix_sum
from txsentry.session import work_dir

THRESHOLD = 0.5
CLASS_NAMES = {0: "normal", 1: "fraud"}


def roc_auc(df: DataFrame, score: str = "fraud_probability", label: str = "is_fraud") -> DataFrame:
    per_score = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label)).cast("double").alias("pos"),
        F.sum(1 - F.col(label)).cast("double").alias("neg"))
    # The per-score table is read three times below (bucket boundaries,
    # running sums, bucket totals) but is small: materialise it once in the
    # shared checkpoint folder so the scored table is scanned once.
    work_dir(df.sparkSession)
    per_score = per_score.checkpoint()
    cum = prefix_sum(per_score, ["s"], "neg", "cum_neg")
    below = F.col("cum_neg") - F.col("neg")
    return cum.agg((F.sum(F.col("pos") * (below + 0.5 * F.col("neg")))
                    / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def threshold_predict(df: DataFrame, score: str = "fraud_probability",
                      threshold: float = THRESHOLD) -> DataFrame:
    return df.withColumn("predicted", (F.col(score) >= threshold).cast("int"))


def confusion_matrix(pred: DataFrame, label: str = "is_fraud") -> DataFrame:
    return pred.groupBy(F.col(label).alias("actual"), "predicted").agg(
        F.count(F.lit(1)).alias("n"))


def _counts(pred: DataFrame, label: str = "is_fraud") -> DataFrame:
    a, p = F.col(label), F.col("predicted")
    return pred.agg(
        F.sum(((a == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((a == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((a == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((a == 0) & (p == 0)).cast("long")).alias("tn"))


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def f1_positive(pred: DataFrame, label: str = "is_fraud") -> DataFrame:
    c = _counts(pred, label)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(_safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_report(pred: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Rows normal, fraud, accuracy, macro avg, weighted avg with precision,
    recall, f1 and support (accuracy row: f1 = accuracy, others null)."""
    c = _counts(pred, label)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    m = c.select(
        _safe_div(tp, tp + fp).alias("p1"), _safe_div(tp, tp + fn).alias("r1"),
        _safe_div(tn, tn + fn).alias("p0"), _safe_div(tn, tn + fp).alias("r0"),
        (tp + fn).alias("s1"), (tn + fp).alias("s0"), total.alias("n"),
        _safe_div(tp + tn, total).alias("acc"))
    f1 = lambda p, r: F.when(F.col(p) + F.col(r) == 0, 0.0).otherwise(
        2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r)))
    m = m.withColumns({"f0": f1("p0", "r0"), "f1": f1("p1", "r1")})
    w0, w1 = F.col("s0") / F.col("n"), F.col("s1") / F.col("n")

    def row(name, precision, recall, f1_score, support):
        return F.struct(F.lit(name).alias("class"), precision.cast("double").alias("precision"),
                        recall.cast("double").alias("recall"), f1_score.alias("f1"),
                        support.alias("support"))

    null = F.lit(None).cast("double")
    c = F.col
    rows = F.array(
        row("normal", c("p0"), c("r0"), c("f0"), c("s0")),
        row("fraud", c("p1"), c("r1"), c("f1"), c("s1")),
        row("accuracy", null, null, c("acc"), c("n")),
        row("macro avg", (c("p0") + c("p1")) / 2, (c("r0") + c("r1")) / 2,
            (c("f0") + c("f1")) / 2, c("n")),
        row("weighted avg", c("p0") * w0 + c("p1") * w1, c("r0") * w0 + c("r1") * w1,
            c("f0") * w0 + c("f1") * w1, c("n")))
    return m.select(F.explode(rows).alias("r")).select("r.*")


def score_range(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    return df.agg(F.min(score).alias("score_min"), F.max(score).alias("score_max"))
