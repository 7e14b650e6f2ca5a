"""Task-level evidence for the hot-key design, from Spark's event log.

usage: python tools/skew_tasks.py [sf_dir]

Moves a third of the feed onto one user, then runs the previous-row lookup
(a) as a plain per-user window and (b) with ``lag_within`` (user, time
bucket), and (c) the trailing 15-minute count with ``trailing_count``.
Prints, per variant, the largest and median number of shuffle records read
by one task of its window stage (taken from SparkListenerTaskEnd events in
an event log written to a fresh scratch folder).
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="txsentry-eventlog-")
    from pyspark.sql import SparkSession, Window
    from pyspark.sql import functions as F

    from txsentry.operators import sequence as S
    from txsentry.session import SESSION_DEFAULTS
    from txsentry.sources.tables import transactions

    b = (SparkSession.builder.master("local[8]").appName("skew-tasks")
         .config("spark.ui.enabled", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
         .config("spark.eventLog.compress", "false")
         .config("spark.sql.shuffle.partitions", "64")
         # Keep the 64 shuffle partitions as they are, so per-task counts
         # show how the rows are spread.
         .config("spark.sql.adaptive.coalescePartitions.enabled", "false"))
    for k, v in SESSION_DEFAULTS.items():
        if k != "spark.sql.adaptive.coalescePartitions.enabled":
            b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    tx = transactions(spark, sf_dir).cache()
    n = tx.count()
    hot = tx.withColumn("user_id", F.when(
        F.substring("transaction_id", 4, 20).cast("bigint") % 3 == 0, F.lit("user_hot"))
        .otherwise(F.col("user_id")))
    w = Window.partitionBy("user_id").orderBy("timestamp", "transaction_id")
    variants = {
        "plain per-user window lag": hot.select(F.lag("country").over(w).alias("p")),
        "lag_within (user, bucket)": S.lag_within(hot, "user_id", "timestamp",
                                                  "transaction_id", ["country"], 86400),
        "trailing_count (user, bucket)": S.trailing_count(hot, "user_id", "timestamp", 900),
    }
    groups = {}
    for name, df in variants.items():
        spark.sparkContext.setJobGroup(name, name)
        df.write.format("noop").mode("overwrite").save()
        groups[name] = name
    spark.stop()

    # Task records read per stage, per job group (variant).
    stage_group, reads = {}, {}
    paths = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus")]
    for path in sorted(paths):
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                    recs = m.get("Total Records Read", 0)
                    if recs:
                        reads.setdefault(ev["Stage ID"], []).append(recs)
    print(f"rows {n}, hot user rows {n // 3 + (1 if n % 3 else 0)}")
    for name in variants:
        stages = [s for s, g in stage_group.items() if g == name and s in reads]
        if not stages:
            continue
        # The window stage: the one reading the most shuffle records.
        s = max(stages, key=lambda x: sum(reads[x]))
        r = reads[s]
        print(f"{name:32s} tasks {len(r):3d}  max records/task {max(r):6d}  "
              f"median {int(statistics.median(r)):6d}")


if __name__ == "__main__":
    main()
