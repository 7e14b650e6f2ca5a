"""Golden vectors of the scoring service's own tests: risk tiers, features
of the example payloads, reasons and request validation."""

import pytest
from pyspark.sql import functions as F

from txsentry.operators import features as FE
from txsentry.operators import reasons as X
from txsentry.operators import risk as R
from txsentry.operators import validate as V
from txsentry.schema import FEATURE_COLUMNS, RiskThresholds
from txsentry.sources.files import from_records

SAFE = {
    "transaction_id": "tx_demo_safe_001", "user_id": "user_29104",
    "merchant_id": "merchant_5031", "amount": 45.50, "transaction_type": "purchase",
    "merchant_category": "grocery", "device_type": "mobile", "channel": "in_store",
    "city": "London", "country": "GB", "timestamp": "2026-03-21T10:30:00Z",
    "is_international": False, "card_present": True,
}
SUSPICIOUS = {
    "transaction_id": "tx_demo_fraud_002", "user_id": "user_88219",
    "merchant_id": "merchant_9911", "amount": 12500.00, "transaction_type": "transfer",
    "merchant_category": "other", "device_type": "desktop", "channel": "online",
    "city": "Unknown City", "country": "RU", "timestamp": "2026-03-21T03:15:00Z",
    "is_international": True, "card_present": False,
}
VALID = {
    "transaction_id": "tx_test_001", "user_id": "user_42", "merchant_id": "merchant_99",
    "amount": 120.995, "transaction_type": "purchase", "merchant_category": "retail",
    "device_type": "mobile", "channel": "mobile_app", "city": "London", "country": "gb",
    "is_international": True, "card_present": False,
}


@pytest.mark.parametrize("p,a,t,level,decision,combined", [
    (0.05, 0.10, RiskThresholds(), "low", "ALLOW", 0.07),
    (0.50, 0.40, RiskThresholds(), "medium", "REVIEW", 0.46),
    (0.90, 0.80, RiskThresholds(), "critical", "BLOCK", 0.86),
    (0.30, 0.30, RiskThresholds(0.10, 0.30, 0.60, 0.5, 0.5), "medium", "REVIEW", 0.30),
])
def test_risk_vectors(spark, p, a, t, level, decision, combined):
    df = spark.createDataFrame([(p, a)], "fraud_probability double, anomaly_score double")
    r = R.assess(df, t).first()
    assert (r.risk_level, r.decision) == (level, decision)
    assert r.combined_score == pytest.approx(combined)


def test_combined_score_clipped(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (-1.0, 0.0)],
                               "fraud_probability double, anomaly_score double")
    scores = [r.combined_score for r in R.assess(df).collect()]
    assert all(0.0 <= s <= 1.0 for s in scores)


def test_level_monotone_in_score(spark):
    rows = [(i / 100, i / 100) for i in range(101)]
    df = spark.createDataFrame(rows, "fraud_probability double, anomaly_score double")
    order = {"low": 0, "medium": 1, "high": 2, "critical": 3}
    levels = [order[r.risk_level] for r in
              R.assess(df).orderBy("combined_score").collect()]
    assert levels == sorted(levels)


@pytest.mark.parametrize("payload,expected", [
    (SAFE, dict(amount_log=3.839452, hour=10, day_of_week=5, is_weekend=1,
                is_night_transaction=0, is_international=0, card_present=1)),
    (SUSPICIOUS, dict(amount_log=9.433564, hour=3, day_of_week=5, is_weekend=1,
                      is_night_transaction=1, is_international=1, card_present=0)),
    (dict(SAFE, amount=0), dict(amount_log=0.0, hour=10, day_of_week=5, is_weekend=1,
                                is_night_transaction=0, is_international=0, card_present=1)),
])
def test_base_features_of_payloads(spark, payload, expected):
    r = FE.base_features(from_records(spark, payload)).first()
    for k, v in expected.items():
        assert r[k] == pytest.approx(v, abs=1e-6), k


def test_feature_matrix_shape_and_order(spark):
    df = from_records(spark, [SAFE, SUSPICIOUS])
    model = FE.FeatureEncoder().fit(df)
    out = model.feature_columns(df)
    assert out.columns[-12:] == FEATURE_COLUMNS
    assert all(t == "double" for _, t in out.dtypes[-12:])
    assert out.count() == 2


def test_unseen_category_codes_minus_one(spark):
    model = FE.FeatureEncoder().fit(from_records(spark, SAFE))
    r = model.feature_columns(from_records(spark, SUSPICIOUS)).first()
    assert r.transaction_type == -1 and r.country == -1 and r.device_type == -1


def test_transform_requires_fit(spark):
    assert not hasattr(FE.FeatureEncoder(), "transform")
    model = FE.FeatureEncoder().fit(from_records(spark, [SAFE, SUSPICIOUS]))
    a = model.feature_columns(from_records(spark, SAFE)).first()
    b = model.feature_columns(from_records(spark, [SAFE, SUSPICIOUS])) \
        .filter(F.col("transaction_id") == SAFE["transaction_id"]).first()
    assert a == b


def test_missing_timestamp_uses_default(spark):
    df = from_records(spark, {k: v for k, v in SAFE.items() if k != "timestamp"}) \
        .drop("timestamp")
    r = FE.base_features(df, default_ts="2026-03-21 23:00:00").first()
    assert (r.hour, r.is_night_transaction) == (23, 1)


@pytest.mark.parametrize("payload,features", [
    (SAFE, [("daytime_transaction", 0.1, "decreases_risk"),
            ("domestic_transaction", 0.1, "decreases_risk")]),
    (SUSPICIOUS, [("high_amount", 0.5, "increases_risk"),
                  ("night_transaction", 0.3, "increases_risk"),
                  ("international_transaction", 0.2, "increases_risk")]),
])
def test_reasons_of_payloads(spark, payload, features):
    acc, _ = V.split(from_records(spark, payload))
    r = X.with_top_reasons(acc).first()
    assert [(x.feature, x.contribution, x.direction) for x in r.top_reasons] == features


def _errors(spark, payload):
    return V.validate(from_records(spark, payload)).first().errors


def test_valid_request_normalised(spark):
    acc, rej = V.split(from_records(spark, VALID), default_ts="2026-03-21 12:00:00")
    assert rej.count() == 0
    r = acc.first()
    assert r.country == "GB" and r.amount == 121.0 and r.device_type == "mobile"
    assert str(r.timestamp) == "2026-03-21 12:00:00"


@pytest.mark.parametrize("change,tag", [
    ({"transaction_id": None}, "missing:transaction_id"),
    ({"user_id": None}, "missing:user_id"),
    ({"amount": -50}, "amount:not_positive"),
    ({"amount": 0}, "amount:not_positive"),
    ({"transaction_type": "gambling"}, "invalid:transaction_type"),
    ({"merchant_category": "rocket_fuel"}, "invalid:merchant_category"),
    ({"merchant_category": "food"}, "invalid:merchant_category"),
    ({"country": "USA"}, "invalid:country"),
])
def test_invalid_requests_rejected(spark, change, tag):
    assert tag in _errors(spark, dict(VALID, **change))


def test_device_defaults_to_unknown(spark):
    acc, _ = V.split(from_records(spark, {k: v for k, v in VALID.items() if k != "device_type"}))
    assert acc.first().device_type == "unknown"


def test_only_ids_rejected(spark):
    errs = _errors(spark, {"transaction_id": "tx_x", "user_id": "u"})
    assert len(errs) == 7


def test_prediction_contract(spark):
    rows = [("t1", 1.5, 0.5, "low", "ALLOW"), ("t2", 0.5, -0.1, "low", "ALLOW"),
            ("t3", 0.5, 0.5, "low", "IGNORE"), ("t4", 0.5, 0.5, "medium", "REVIEW")]
    df = spark.createDataFrame(rows, "transaction_id string, fraud_probability double, "
                                     "anomaly_score double, risk_level string, decision string")
    df = df.withColumn("top_reasons", F.array(F.struct(
        F.lit("x").alias("feature"), F.lit(0.1).alias("contribution"),
        F.lit("increases_risk").alias("direction"))))
    errs = {r.transaction_id: r.errors for r in V.prediction_check(df).collect()}
    assert errs["t1"] == ["fraud_probability:out_of_range"]
    assert errs["t2"] == ["anomaly_score:out_of_range"]
    assert errs["t3"] == ["decision:invalid"]
    assert errs["t4"] == []
