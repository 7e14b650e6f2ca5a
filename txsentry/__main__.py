"""Command line: ``python -m txsentry <command>`` (or spark-submit this module).

  train    --data PATH --out DIR [--rounds N] [--algo gbt|rf]
           PATH: a labelled CSV file/folder, or a folder of driver tables
           (the labelled feed is derived from them).  Writes the models and
           DIR/metadata.json.
  score    --models DIR --input PATH --out PATH [--audit PATH] [--batch ID]
           PATH: transactions as CSV (labelled layout), JSON lines or Parquet.
           With --batch a repeated run leaves its audit rows once.
  requests --models DIR --input PATH --root DIR [--batch ID]
           Validate, score and audit raw requests; all tables under DIR are
           published together.
  validate --input PATH --accepted PATH --quarantine PATH
  recent   --audit PATH [--limit N]

Paths may be on any store that Spark reads.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid

from pyspark.sql import functions as F

from txsentry.session import build_session


def _read_transactions(spark, path: str, raw: bool = False):
    from txsentry.operators.audit_log import exists
    from txsentry.sources import files as S
    from txsentry.sources.tables import transactions
    if "*" not in path and exists(spark, f"{path}/events.parquet"):
        return transactions(spark, path)
    if path.endswith(".json") or path.endswith(".jsonl"):
        return S.read_transactions_json(spark, path, raw=raw)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return S.read_raw_csv(spark, path) if raw else S.read_labelled_csv(spark, path)


def _scorer(spark, models: str):
    from txsentry.plans import scoring as P
    from txsentry.sources import files as S
    meta = S.read_text(spark, f"{models}/metadata.json")
    return P.Scorer.load(spark, models, json.loads(meta)["algorithms"]["supervised"] if meta else "GBTClassifier")


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="txsentry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--data", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--rounds", type=int, default=300)
    t.add_argument("--algo", choices=["gbt", "rf"], default="gbt")
    s = sub.add_parser("score")
    s.add_argument("--models", required=True)
    s.add_argument("--input", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--audit")
    s.add_argument("--batch")
    q = sub.add_parser("requests")
    q.add_argument("--models", required=True)
    q.add_argument("--input", required=True)
    q.add_argument("--root", required=True)
    q.add_argument("--batch")
    v = sub.add_parser("validate")
    v.add_argument("--input", required=True)
    v.add_argument("--accepted", required=True)
    v.add_argument("--quarantine", required=True)
    r = sub.add_parser("recent")
    r.add_argument("--audit", required=True)
    r.add_argument("--limit", type=int, default=20)
    args = ap.parse_args(argv)

    spark = build_session(os.environ.get("TXSENTRY_MASTER"), shuffle_partitions=None)
    from txsentry.operators import audit as A
    from txsentry.operators import audit_log as L
    from txsentry.plans import scoring as P

    if args.cmd == "train":
        meta = P.training_summary(spark, _read_transactions(spark, args.data), args.out,
                                  dataset_path=args.data, max_iter=args.rounds, algo=args.algo)
        from txsentry.sources.files import write_text
        write_text(spark, json.dumps(meta, indent=2, default=str), f"{args.out}/metadata.json")
        print(json.dumps(meta["metrics"]))
    elif args.cmd == "score":
        batch = args.batch or uuid.uuid4().hex      # a run of its own unless it is named
        answered = P.responses(_scorer(spark, args.models), _read_transactions(spark, args.input)) \
            .withColumnRenamed("timestamp", "event_time").withColumn("timestamp", F.current_timestamp())
        answered.write.mode("overwrite").parquet(args.out)
        if args.audit:
            # The payload holds the request's own time, the row that of the answer.
            rows = spark.read.parquet(args.out).withColumnsRenamed({"timestamp": "answered_at", "event_time": "timestamp"})
            L.append(A.audit_rows(rows, batch_id=batch, created_at="answered_at"), args.audit, batch)
    elif args.cmd == "requests":
        from txsentry.streaming import requests as Q
        scorer = _scorer(spark, args.models)
        Q.process(_read_transactions(spark, args.input, raw=True), args.root, lambda df: P.responses(scorer, df),
                  "batch", args.batch or uuid.uuid4().hex)
    elif args.cmd == "validate":
        from txsentry.operators import validate as V
        raw = _read_transactions(spark, args.input, raw=True)
        accepted, rejected = V.split(raw)
        accepted.write.mode("overwrite").parquet(args.accepted)
        rejected.write.mode("overwrite").parquet(args.quarantine)
    elif args.cmd == "recent":
        for row in L.newest(spark, args.audit, args.limit).collect():
            print(json.dumps(row.asDict(), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
