"""Exact medians by narrowing intervals, with brackets that miss and brackets that are cut."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from txsentry.operators import stats as ST


def groups(seed):
    rng = random.Random(seed)
    return {"wide": [rng.lognormvariate(0, 6) for _ in range(401)], "few": [1.0, 2.0], "one": [7.5], "same": [3.0] * 200,
            "two": [1.0] * 50 + [2.0] * 50, "gap": [float(k) for k in range(100)] + [1e9 + k for k in range(100)],
            "outlier": [rng.random() for _ in range(300)] + [1e300, -1e300], None: [float(k % 17) for k in range(90)], "none": [None, None]}


def frame(spark, data, kind="double"):
    rows = [(g, v) for g, vs in data.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double").withColumn("v", F.col("v").cast(kind)).repartition(5)


@pytest.mark.parametrize("sketch,values,splits", [(10_000, 1_000_000, 1024), (4, 5, 3), (1_000_000, 3, 2), (5, 40, 7)])
def test_medians(spark, monkeypatch, sketch, values, splits):
    monkeypatch.setattr(ST, "SKETCH", sketch)
    monkeypatch.setattr(ST, "TASK_VALUES", values)
    monkeypatch.setattr(ST, "SPLITS", splits)
    data = groups(sketch)
    got = {r.g: r["median"] for r in ST.exact_median(frame(spark, data), ["g"], "v").collect()}
    assert got == {g: statistics.median(vs) for g, vs in data.items() if g != "none"}


def test_a_bracket_that_misses_is_replaced(spark, monkeypatch):
    """A sketch that brackets nothing: every group falls back to its range."""
    real = F.percentile_approx
    monkeypatch.setattr(ST.F, "percentile_approx", lambda v, q, a: F.array(F.lit(-5.0), F.lit(-4.0)) if isinstance(q, list) else real(v, q, a))
    data = groups(2)
    got = {r.g: r["median"] for r in ST.exact_median(frame(spark, data), ["g"], "v").collect()}
    assert got == {g: statistics.median(vs) for g, vs in data.items() if g != "none"}


def test_extras_keep_groups_without_values_and_other_types(spark):
    data = {g: vs for g, vs in groups(3).items() if g not in ("wide", "outlier", "gap")}
    rows = ST.exact_median(frame(spark, data, "int"), ["g"], "v", (F.max("v").alias("top"), F.count("*").alias("n"))).collect()
    whole = {g: [int(v) for v in vs if v is not None] for g, vs in data.items()}
    assert {r.g: (r["median"], r.top) for r in rows} == {g: (statistics.median(vs) if vs else None, max(vs, default=None)) for g, vs in whole.items()}
    assert {r.g: r.n for r in rows}["none"] == 2


def test_no_rows(spark):
    assert ST.exact_median(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_the_feed_is_read_twice(spark, tx_small, monkeypatch):
    reads = []
    real = ST.stored
    monkeypatch.setattr(ST, "stored", lambda df, name: (reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("event_id")), real(df, name))[1])
    out = ST.exact_median(tx_small, ["is_fraud"], "amount", (F.max("amount").alias("m"),))
    assert out.count() == 2 and sum(1 for r in reads if r) == 2
    assert "events.parquet" not in out._jdf.queryExecution().executedPlan().toString()
