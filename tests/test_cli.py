"""The command line: train, score with audit, validate, recent."""

import json
import os

from sf_paths import SF_SMALL
from txsentry.__main__ import main
from txsentry.session import scratch_path


def test_cli_train_score_recent(spark, capsys):
    models = scratch_path(spark, "cli-models")
    assert main(["train", "--data", SF_SMALL, "--out", models, "--rounds", "3"]) == 0
    meta = json.load(open(os.path.join(models, "metadata.json")))
    assert meta["dataset_rows"] == 1000 and meta["algorithms"]["supervised"] == "GBTClassifier"
    out, audit = scratch_path(spark, "cli-scores"), scratch_path(spark, "cli-audit")
    assert main(["score", "--models", models, "--input", SF_SMALL, "--out", out,
                 "--audit", audit]) == 0
    assert spark.read.parquet(out).count() == 1000
    assert spark.read.parquet(audit).count() == 1000
    capsys.readouterr()
    assert main(["recent", "--audit", audit, "--limit", "5"]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert len(lines) == 5 and "decision" in json.loads(lines[0])


def test_cli_validate(spark, tx_small):
    src = scratch_path(spark, "cli-raw")
    from txsentry.sources.tables import raw_from
    raw_from(tx_small).write.json(src)
    acc, quar = scratch_path(spark, "cli-acc"), scratch_path(spark, "cli-quar")
    assert main(["validate", "--input", src + "/*.json", "--accepted", acc,
                 "--quarantine", quar]) == 0
    assert spark.read.parquet(acc).count() + spark.read.parquet(quar).count() == 1000
    from txsentry.operators.validate import split
    _, rej = split(raw_from(tx_small))
    assert spark.read.parquet(quar).count() == rej.count()


def test_cli_keeps_audit_rows_of_named_batches_once(spark, tx_small):
    models = scratch_path(spark, "cli-models")
    assert main(["train", "--data", SF_SMALL, "--out", models, "--rounds", "2"]) == 0
    from txsentry.operators import audit as A
    from txsentry.operators import audit_log as L
    out, audit, root = (scratch_path(spark, n) for n in ("cli-scores", "cli-audit", "cli-requests"))
    for batch in ([], ["--batch", "b1"], ["--batch", "b1"]):
        assert main(["score", "--models", models, "--input", SF_SMALL, "--out", out, "--audit", audit, *batch]) == 0
    rows = A.parse_json(L.read(spark, audit))
    assert rows.count() == 2000 and rows.select("id").distinct().count() == 2000
    times = {r.transaction_id: r.timestamp for r in tx_small.collect()}
    assert all(r.payload.timestamp == times[r.transaction_id] for r in rows.select("transaction_id", "payload").collect())


def test_cli_requests_from_csv_text(spark, tx_small):
    """Malformed text in a CSV file reaches the rules by its own reason."""
    from txsentry.operators import audit_log as L
    from txsentry.operators.validate import reject_summary
    from txsentry.sources.tables import raw_from
    from txsentry.streaming import requests as Q
    models, src, root = (scratch_path(spark, n) for n in ("cli-models", "cli-csv", "cli-root"))
    raw = raw_from(tx_small)
    raw.write.option("header", "true").csv(src)
    assert main(["train", "--data", SF_SMALL, "--out", models, "--rounds", "2"]) == 0
    for _ in range(2):
        assert main(["requests", "--models", models, "--input", src, "--root", root, "--batch", "1"]) == 0
    assert {r.error: r.n for r in Q.error_counts(spark, root).collect()} == {r.error: r.n for r in reject_summary(raw).collect()}
    assert Q.predictions(spark, root).count() == Q.accepted(spark, root).count() == L.read(spark, Q.audit_path(root)).count() > 0
