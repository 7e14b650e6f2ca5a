"""Training job (Q7) and whole-batch scoring (M8), the flagship plan.

Train: read -> stratified split (exact per-class sizes) -> fit the feature
encoder on the training rows (``fit_on="all"`` fits it before
the split) -> boosted trees (or a random forest) -> isolation forest
-> evaluation on the test rows -> risk decisions -> metadata.

Score: features (one codegen projection) -> classifier (JVM) -> forest
(Arrow-batched pandas UDF over the broadcast node table) -> risk tier,
decision and reasons (codegen).  No shuffle at all: scoring is a narrow
map over the input, on batch or stream alike.
"""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsentry.functions import reasons as reason_rules
from txsentry.functions import risk as R
from txsentry.operators import evaluate as Q
from txsentry.operators import iforest as IF
from txsentry.operators import models as M
from txsentry.operators import reasons as X
from txsentry.operators import risk as risk_ops
from txsentry.operators.features import FeatureEncoder, FeatureModel
from txsentry.operators.prepare import stratified_split
from txsentry.operators.scratch import stored
from txsentry.schema import (CATEGORICAL_COLS, DEFAULT_THRESHOLDS, FEATURE_COLUMNS,
                             NUMERIC_COLS, RiskThresholds)
from txsentry.sources.tables import transactions, tx_number

MODEL_VERSION = "1.0.0"


@dataclass
class Scorer:
    features: FeatureModel
    classifier: object
    forest: IF.IsolationForestModel
    algorithm: str
    thresholds: RiskThresholds = DEFAULT_THRESHOLDS
    metrics: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        PipelineModel(stages=[self.features, self.classifier]).write().overwrite() \
            .save(os.path.join(path, "pipeline"))
        IF.save(self.forest, spark, os.path.join(path, "forest"))
        spark.createDataFrame([asdict(self.thresholds)]).coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(path, "thresholds"))

    @staticmethod
    def load(spark: SparkSession, path: str, algorithm: str = "GBTClassifier") -> "Scorer":
        pm = PipelineModel.load(os.path.join(path, "pipeline"))
        forest = IF.load(spark, os.path.join(path, "forest"))
        bands = spark.read.parquet(os.path.join(path, "thresholds")).first().asDict()
        return Scorer(pm.stages[0], pm.stages[1], forest, algorithm, RiskThresholds(**bands))


def split(tx: DataFrame, seed: int = 42) -> DataFrame:
    return stratified_split(tx, "is_fraud", 0.2, seed, tx_number(F.col("transaction_id")))


def train(spark: SparkSession, tx: DataFrame, fit_on: str = "train", algo: str = "gbt",
          max_iter: int = M.GBT_PARITY_ROUNDS, rf_trees: int = M.RF_PARITY_TREES,
          forest_trees: int = IF.N_TREES, seed: int = 42) -> tuple[Scorer, DataFrame]:
    """Fit everything; returns the scorer and the split table (``is_test``)."""
    parts = split(tx, seed).persist()
    train_rows = parts.filter(F.col("is_test") == 0)
    enc = FeatureEncoder(keepCols=["is_fraud", "is_test"]).fit(
        train_rows if fit_on == "train" else parts)
    train_feats = enc.transform(train_rows)
    if algo == "gbt":
        clf, name = M.train_gbt(train_feats, max_iter, seed), "GBTClassifier"
    else:
        clf, name = M.train_rf(train_feats, rf_trees, seed), "RandomForestClassifier"
    forest = IF.fit(enc.feature_columns(train_rows), FEATURE_COLUMNS, n_trees=forest_trees,
                    seed=seed)
    return Scorer(enc, clf, forest, name), parts


def assessed(scorer: Scorer, df: DataFrame) -> DataFrame:
    """``df`` with unrounded fraud_probability, anomaly_score and raw_score, risk
    level and decision."""
    spark = df.sparkSession
    feats = scorer.features.assemble(df.withColumn("_row", F.struct(*df.columns)), keep=("_row",))
    probs = M.fraud_probability(scorer.classifier, feats)
    raw = scorer.forest.raw_score(spark)
    out = probs.withColumn("raw_score", raw) \
               .withColumn("anomaly_score", scorer.forest.anomaly_score(F.col("raw_score")))
    out = out.select("_row.*", "fraud_probability", "anomaly_score", "raw_score")
    return risk_ops.assess(out, scorer.thresholds)


def responses(scorer: Scorer, df: DataFrame) -> DataFrame:
    """Request rows plus the response columns (rounded scores, tier, decision,
    reasons); the request's own columns, its timestamp included, stay."""
    return X.with_top_reasons(assessed(scorer, df)).withColumns(
        {c: R.rounded(c) for c in ("fraud_probability", "anomaly_score")})


AMOUNT_SCALE = 5000.0


def rule_responses(df: DataFrame, thresholds: RiskThresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """As ``responses`` without any trained model: the explanation rules' risk
    contributions, summed, stand for the probability, and the amount against
    ``AMOUNT_SCALE`` for the anomaly score."""
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    scored = df.withColumns({"fraud_probability": reason_rules.risk_sum(reason_rules.all_reasons()),
                             "anomaly_score": amount / (amount + AMOUNT_SCALE)})
    return X.with_top_reasons(risk_ops.assess(scored, thresholds)).withColumns(
        {c: R.rounded(c) for c in ("fraud_probability", "anomaly_score")})


def score(scorer: Scorer, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prediction rows for every input row (response shape plus the
    columns in ``keep``)."""
    return X.with_top_reasons(assessed(scorer, df)).select(
        F.coalesce("transaction_id", F.lit("unknown")).alias("transaction_id"),
        R.rounded("fraud_probability").alias("fraud_probability"),
        R.rounded("anomaly_score").alias("anomaly_score"),
        "risk_level", "decision", "top_reasons",
        F.current_timestamp().alias("timestamp"),
        *keep)


def evaluate(scorer: Scorer, test: DataFrame) -> dict:
    # Metrics need unrounded scores; scored once, every metric reads the table.
    pred = stored(assessed(scorer, test).select("is_fraud", "fraud_probability", "anomaly_score", "decision"), "test-scores")
    auc = Q.roc_auc(pred).first()["auc"]
    f1 = Q.f1_positive(Q.threshold_predict(pred)).first()["f1"]
    rng = pred.agg(F.min("anomaly_score").alias("lo"), F.max("anomaly_score").alias("hi")).first()
    counts = {r["decision"]: r["n"] for r in risk_ops.decision_counts(pred).collect()}
    report = {r["class"]: {k: r[k] for k in ("precision", "recall", "f1", "support")}
              for r in Q.classification_report(Q.threshold_predict(pred)).collect()}      # five rows
    return {"report": report,"supervised_auc": round(float(auc), 4), "supervised_f1": round(float(f1), 4),
            "anomaly_test_min": float(rng["lo"]), "anomaly_test_max": float(rng["hi"]),
            "decisions": counts}


def training_summary(spark: SparkSession, tx: DataFrame, out_dir: str, dataset_path: str,
                     **train_args) -> dict:
    """Run the whole training job, save artifacts and metadata; return the metadata."""
    scorer, parts = train(spark, tx, **train_args)
    test = parts.filter(F.col("is_test") == 1).drop("is_test")
    metrics = evaluate(scorer, test)
    overview = parts.agg(F.count(F.lit(1)).alias("n"), F.avg("is_fraud").alias("r")).first()
    art = {"supervised_model": os.path.join(out_dir, "pipeline"),
           "anomaly_model": os.path.join(out_dir, "forest"),
           "preprocessor": os.path.join(out_dir, "pipeline")}
    scorer.save(spark, out_dir)
    t = scorer.thresholds
    meta = {
        "model_version": MODEL_VERSION,
        "training_timestamp": dt.datetime.now(dt.timezone.utc).isoformat(),
        "dataset_path": dataset_path,
        "dataset_rows": int(overview["n"]),
        "fraud_ratio": round(float(overview["r"]), 4),
        "feature_names": list(FEATURE_COLUMNS),
        "categorical_columns": list(CATEGORICAL_COLS),
        "numeric_columns": list(NUMERIC_COLS),
        "algorithms": {"supervised": scorer.algorithm, "anomaly": "IsolationForest"},
        "metrics": {"supervised_auc": metrics["supervised_auc"],
                    "supervised_f1": metrics["supervised_f1"],
                    "anomaly_test_min": metrics["anomaly_test_min"],
                    "anomaly_test_max": metrics["anomaly_test_max"]},
        "decisions": metrics["decisions"],
        "classification_report": metrics["report"],
        "thresholds": {"low_max": t.low_max, "medium_max": t.medium_max,
                       "high_max": t.high_max, "alpha": t.alpha, "beta": t.beta},
        "artifacts": art,
    }
    parts.unpersist()
    return meta


def flagship(spark: SparkSession, sf_dir: str, max_iter: int = M.GBT_PARITY_ROUNDS,
             forest_trees: int = IF.N_TREES) -> DataFrame:
    """Train on the feed's training split, then score the whole feed."""
    tx = transactions(spark, sf_dir)
    scorer, parts = train(spark, tx, max_iter=max_iter, forest_trees=forest_trees)
    parts.unpersist()
    return score(scorer, tx)



class InvalidRequest(ValueError):
    """Raised by ``predict_records`` with the violated rules per request."""

    def __init__(self, errors: dict):
        super().__init__(f"invalid requests: {errors}")
        self.errors = errors


def predict_records(spark: SparkSession, scorer: Scorer, records) -> list[dict]:
    """Request payloads (dict or list of dicts) -> response dicts, as the
    scoring service returns them.  Invalid requests raise ``InvalidRequest``
    with their rule violations.  For request-sized inputs; tables go through
    ``score``."""
    from txsentry.operators import validate as V
    from txsentry.sources.files import from_records
    accepted, rejected = V.split(from_records(spark, records))
    bad = {r["transaction_id"]: list(r["errors"]) for r in
           rejected.select("transaction_id", "errors").collect()}
    if bad:
        raise InvalidRequest(bad)
    out = []
    for r in score(scorer, accepted).collect():
        d = r.asDict(recursive=True)
        d["timestamp"] = d["timestamp"].isoformat()
        out.append(d)
    return out
