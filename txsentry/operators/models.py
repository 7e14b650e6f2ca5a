"""Supervised classifiers (M1-M3) on Spark ML.

Boosted trees use these settings where Spark has them: depth 6,
learning rate 0.05, row subsample 0.8, 80% of the features, positive class
weight 10.  Spark's feature subset is drawn per node, not per tree, so
probabilities are not digit-for-digit those of other libraries.  300 rounds
and 300 trees are the parity settings and the defaults; queries use these.

Every labelled row is fitted: rounds and levels are jobs over all of them, kept
in memory or on disk while the model is fitted.  Only a caller that passes
``max_rows`` gets a fit on a weighted sample (``bounded_sample``); no query does.
Spark's learners choose the values a split may test (31 a feature) from about
10,000 of the rows they are given; which of these is taken, and every leaf,
comes from all rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txsentry.operators.prepare import with_weights

GBT_PARITY_ROUNDS = 300
RF_PARITY_TREES = 300


MAX_CLASS_ROWS = 100_000    # of each class in a sample; a fit takes all rows unless it is told otherwise
# Each round is a job per tree level, so tasks are few: fitted rows of a task, and the least it gets while cores are free.
ROWS_PER_TASK = 200_000
LEAST_ROWS_PER_TASK = 20_000
_HASHES = 1 << 62


def class_counts(df: DataFrame, label: str = "is_fraud") -> dict[int, int]:
    """Rows of class 0 and of class 1."""
    row = df.agg(*[F.count_if(F.col(label) == c).alias(f"n{c}") for c in (0, 1)]).first()
    return {c: row[f"n{c}"] for c in (0, 1)}


def bounded_sample(df: DataFrame, label: str = "is_fraud", max_rows: int = MAX_CLASS_ROWS, seed: int = 42,
                   key: tuple[str, ...] = ("transaction_id", "features"), n: dict[int, int] | None = None) -> DataFrame:
    """At most ``max_rows`` rows of each class (0, 1) with ``sample_weight``.

    A class that is larger gives its ``max_rows`` rows of lowest seeded hash of
    ``key`` (bottom-k sampling), each weighing n / max_rows, so sums over the
    class keep their expectation; smaller classes are whole and weigh 1.  Rows
    of other labels are left out.  Only hashes below a bound that some more
    than ``max_rows`` rows are expected to stay under reach the ranking.
    """
    n = class_counts(df, label) if n is None else n
    if max(n.values()) <= max_rows:
        return df.filter(F.col(label).isin(0, 1)).withColumn("sample_weight", F.lit(1.0))
    parts = [vector_to_array(F.col(c)) if df.schema[c].dataType.typeName() == "vector" or "VectorUDT" in str(df.schema[c].dataType)
             else F.col(c) for c in key if c in df.columns]
    keyed = df.withColumn("_hash", F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(_HASHES)))
    share = {c: min(1.0, 1.2 * max_rows / max(n[c], 1)) for c in n}
    while True:
        below = [(F.col(label) == c) & (F.col("_hash") <= int(share[c] * _HASHES)) for c in n]
        near = keyed.filter(below[0] | below[1])
        got = class_counts(near, label)
        short = [c for c in n if got[c] < min(n[c], max_rows)]
        if not short:
            break
        for c in short:             # rows with one key share a hash and may lie above the bound together
            share[c] = min(1.0, 4 * share[c])
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_hash"))
    weight = F.when(F.col(label) == 1, n[1] / max(1, min(n[1], max_rows))).otherwise(n[0] / max(1, min(n[0], max_rows)))
    return (near.withColumn("_rank", rank).filter(F.col("_rank") <= max_rows)
            .withColumn("sample_weight", weight.cast("double")).drop("_hash", "_rank"))


def _tasks(rows: int, cores: int) -> int:
    """Tasks that ``rows`` fitted rows are dealt to."""
    return max(1, -(-rows // ROWS_PER_TASK), min(cores, -(-rows // LEAST_ROWS_PER_TASK)))


def _weighted(train: DataFrame, label: str, mode: str, max_rows: int | None, seed: int, features: str) -> DataFrame:
    """The fitted rows, all of class 0 and 1 with their class weight, dealt evenly to
    tasks.  With ``max_rows``, a ``bounded_sample`` of them, weighted by both."""
    rows = with_weights(train, label, mode).filter(F.col("weight").isNotNull())
    n = class_counts(train, label)
    if max_rows is not None:
        rows = (bounded_sample(rows, label, max_rows, seed, ("transaction_id", features), n)
                .withColumn("weight", F.col("weight") * F.col("sample_weight")))
        n = {c: min(x, max_rows) for c, x in n.items()}
    rows = rows.select(features, F.col(label).cast("double").alias(label), "weight")
    return rows.repartition(_tasks(sum(n.values()), train.sparkSession.sparkContext.defaultParallelism))


def _fit(estimator, data: DataFrame):
    data = data.persist()
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


def train_gbt(train: DataFrame, max_iter: int = GBT_PARITY_ROUNDS, seed: int = 42,
              features: str = "features", label: str = "is_fraud", max_rows: int | None = None):
    """Boosted trees on all labelled rows (with ``max_rows``: a ``bounded_sample``)."""
    data = _weighted(train, label, "scale", max_rows, seed, features)
    gbt = GBTClassifier(featuresCol=features, labelCol=label, weightCol="weight",
                        maxIter=max_iter, maxDepth=6, stepSize=0.05, subsamplingRate=0.8,
                        featureSubsetStrategy="0.8", seed=seed)
    return _fit(gbt, data)


def train_rf(train: DataFrame, num_trees: int = RF_PARITY_TREES, seed: int = 42,
             features: str = "features", label: str = "is_fraud", max_rows: int | None = None):
    """A random forest on all labelled rows (with ``max_rows``: a ``bounded_sample``)."""
    data = _weighted(train, label, "balanced", max_rows, seed, features)
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, weightCol="weight",
                                numTrees=num_trees, maxDepth=12, seed=seed)
    # The copy is without the training summary, which holds the session: tasks cannot be sent it once a query was observed.
    return _fit(rf, data).copy()


def fraud_probability(model, df: DataFrame, out: str = "fraud_probability") -> DataFrame:
    """P(class 1) of a fitted classifier; an untrained estimator has no
    ``transform``, so scoring before training fails by construction."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]) \
                 .drop("rawPrediction", "probability", "prediction")
