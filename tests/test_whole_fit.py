"""Classifiers are fitted on every labelled row, however many there are."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__
from txsentry.operators import models as M
from txsentry.operators.prepare import POSITIVE_WEIGHT

EVENTS = 130_000        # 35 of 1,000 are fraud
N1 = EVENTS * 35 // 1000
TRAIN = {0: (EVENTS - N1) * 4 // 5, 1: N1 * 4 // 5}


class Given(Exception):
    """What an estimator was given: rows and weight of each class."""


class Estimator:
    def __init__(self, **settings):
        pass

    def fit(self, data):
        raise Given({int(r.is_fraud): (r.n, round(r.w, 3)) for r in
                     data.groupBy("is_fraud").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()})


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """events and customer with more training rows of a class than MAX_CLASS_ROWS."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.range(EVENTS).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id * 7) AS ts", "id % 500 AS user_id",
        "element_at(array('purchase', 'click', 'view'), cast(id % 3 + 1 AS int)) AS event_type",
        "cast(id % 911 AS double) AS value", "'{}' AS props").write.parquet(f"{at}/events.parquet")
    spark.range(500).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(f"{at}/customer.parquet")
    return at


@pytest.mark.parametrize("name,weight", [("train_gbt", {0: 1.0, 1: POSITIVE_WEIGHT}),
                                         ("training_summary", {0: 1.0, 1: POSITIVE_WEIGHT}),
                                         ("train_rf", {c: sum(TRAIN.values()) / (2 * n) for c, n in TRAIN.items()})])
def test_the_query_fits_all_training_rows(spark, monkeypatch, tables, name, weight):
    assert max(TRAIN.values()) > M.MAX_CLASS_ROWS
    monkeypatch.setattr(M, "GBTClassifier", Estimator)
    monkeypatch.setattr(M, "RandomForestClassifier", Estimator)
    with pytest.raises(Given) as given:
        __spark_entry__.queries()[name](spark, tables)
    assert given.value.args[0] == {c: (n, round(n * weight[c], 3)) for c, n in TRAIN.items()}


def test_a_forest_scores_after_a_query_was_observed(spark):
    seen = Observation()
    df = (spark.range(200).withColumn("is_fraud", (F.col("id") % 4 == 0).cast("int"))
          .withColumn("features", array_to_vector(F.array(F.col("id") % 4 + F.lit(0.0), F.col("id") % 7 + F.lit(0.0)))))
    df.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 200
    model = M.train_rf(df, num_trees=3)
    assert model.getNumTrees == 3 and M.fraud_probability(model, df).filter("fraud_probability BETWEEN 0 AND 1").count() == 200


def test_tasks_grow_with_the_rows():
    assert [M._tasks(n, 8) for n in (0, 1, 20_001, 1_000_000, 5_000_000, 10**9)] == [1, 1, 2, 8, 25, 5000]
    assert M._tasks(5_000_000, 1000) == 250
