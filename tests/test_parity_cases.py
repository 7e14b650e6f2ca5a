"""Remaining cases of the scoring service's own test list: optional fields,
booleans, untrained models, batch transform, score -> audit round trip."""

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from test_golden import SAFE, SUSPICIOUS, VALID
from txsentry.operators import audit as A
from txsentry.operators import features as FE
from txsentry.operators import validate as V
from txsentry.plans import scoring as P
from txsentry.schema import FEATURE_COLUMNS
from txsentry.session import scratch_path
from txsentry.sources.files import from_records


def test_missing_optional_field_handled(spark):
    model = FE.FeatureEncoder().fit(from_records(spark, [SAFE, SUSPICIOUS]))
    payload = {k: v for k, v in SAFE.items() if k != "device_type"}
    row = model.feature_columns(from_records(spark, payload)).first()
    assert [row[c] is not None for c in FEATURE_COLUMNS] == [True] * 12
    assert row.device_type == -1  # "unknown" was not seen at fit time


def test_absent_columns_handled(spark):
    """A frame without some request columns at all still yields 12 features."""
    model = FE.FeatureEncoder().fit(from_records(spark, [SAFE, SUSPICIOUS]))
    df = from_records(spark, SAFE).drop("device_type", "card_present", "is_international")
    out = model.feature_columns(df)
    assert out.columns[-12:] == FEATURE_COLUMNS and out.count() == 1


@pytest.mark.parametrize("text,flag", [("True", 1), ("true", 1), ("1", 1), ("yes", 1),
                                       ("False", 0), ("false", 0), ("0", 0), (None, 0)])
def test_boolean_text_parsing(spark, text, flag):
    r = FE.base_features(from_records(spark, dict(SAFE, is_international=text))).first()
    assert r.is_international == flag


def test_invalid_boolean_text_rejected(spark):
    errs = V.validate(from_records(spark, dict(VALID, card_present="maybe"))).first().errors
    assert errs == ["invalid:card_present"]


def test_untrained_models_cannot_score():
    assert not hasattr(GBTClassifier(), "transform")
    assert not hasattr(FE.FeatureEncoder(), "transform")


def test_batch_transform_rows(spark):
    model = FE.FeatureEncoder().fit(from_records(spark, [SAFE, SUSPICIOUS]))
    out = model.transform(from_records(spark, [SAFE, SUSPICIOUS, SAFE]))
    assert out.count() == 3 and "features" in out.columns


def test_score_then_audit_round_trip(spark, tx_small):
    scorer, _ = P.train(spark, tx_small, max_iter=3, forest_trees=10)
    acc, _ = V.split(from_records(spark, [SAFE, SUSPICIOUS]))
    pred = P.score(scorer, acc, keep=("user_id",))
    path = scratch_path(spark, "audit-e2e")
    assert A.try_audit_append(A.audit_rows(pred, created_at=None), path)
    back = A.read_audit(spark, path)
    joined = back.join(pred.select("transaction_id", F.col("decision").alias("d")),
                       "transaction_id")
    assert joined.count() == 2 and joined.filter(F.col("decision") != F.col("d")).count() == 0
    recent = A.recent(back, 20).collect()
    assert len(recent) == 2


def test_predict_records_response_and_422(spark, tx_small):
    scorer, _ = P.train(spark, tx_small, max_iter=3, forest_trees=10)
    resp = P.predict_records(spark, scorer, SUSPICIOUS)
    assert len(resp) == 1
    r = resp[0]
    assert set(r) == {"transaction_id", "fraud_probability", "anomaly_score", "risk_level",
                      "decision", "top_reasons", "timestamp"}
    assert [x["feature"] for x in r["top_reasons"]] == ["high_amount", "night_transaction",
                                                       "international_transaction"]
    with pytest.raises(P.InvalidRequest) as err:
        P.predict_records(spark, scorer, {"transaction_id": "tx_x", "user_id": "u"})
    assert "missing:amount" in err.value.errors["tx_x"]
