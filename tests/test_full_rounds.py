"""Registered model queries train the whole model: 300 rounds, 300 trees."""

import pytest

import __spark_entry__
from txsentry.operators import models as M

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["train_gbt", "train_rf", "fraud_probability", "score_transactions", "training_summary",
                                  "stream_score", "entry"])
def test_queries_train_300(spark, monkeypatch, name):
    def asked(**settings):
        raise Asked(settings.get("maxIter", settings.get("numTrees")))

    monkeypatch.setattr(M, "GBTClassifier", asked)
    monkeypatch.setattr(M, "RandomForestClassifier", asked)
    with pytest.raises(Asked, match="^300$"):
        if name == "entry":
            __spark_entry__.entry(spark)
        else:
            __spark_entry__.queries()[name](spark, SF)
