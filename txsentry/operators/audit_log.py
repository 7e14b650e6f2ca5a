"""Append-only audit log with a zone manifest.

An append writes ``path/append=<id>/created_date=<day>`` and then one manifest
row in ``path-manifest/append=<id>``: what it holds of every day (rows, oldest
and newest ``created_at``, rows per decision) and counts that the writer wants
to keep.  The manifest row is the commit: rows of an append without one are
never read, an append that has one is not written again, so a job that dies
between its steps and is repeated leaves each row once.

Reads of the newest rows look at zones first, newest to oldest, and open only
the day folders that can hold the answer; totals per decision are sums over
zones and open no data at all.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentry.operators.audit import BLOOM_OPTIONS, MAX_RECENT
from txsentry.schema import AUDIT, DECISIONS

ZONE = "struct<created_date:date,n:bigint,oldest:timestamp,newest:timestamp,decisions:map<string,bigint>>"
MANIFEST = f"zones array<{ZONE}>, info map<string,bigint>, append string"
MAX_FOLDERS = 1000      # day folders that a read of newest rows names one by one


def manifest_path(path: str) -> str:
    return path.rstrip("/") + "-manifest"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per published append: its zones, counts and id."""
    at = manifest_path(path)
    if not exists(spark, at):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(at)


def is_published(spark: SparkSession, path: str, append: str) -> bool:
    """Whether this append has its manifest row (a finished write of it)."""
    return exists(spark, f"{manifest_path(path)}/append={append}/_SUCCESS")


def zones(spark: SparkSession, path: str) -> DataFrame:
    """(append, created_date, n, oldest, newest, decisions) of all published appends."""
    return manifest(spark, path).select("append", F.inline("zones"))


def stage(rows: DataFrame, path: str, append: str) -> None:
    """Write the rows of an append; nothing of it is visible yet.  Rows are dealt
    by day, large days to several tasks, so that a day is few files."""
    (rows.hint("rebalance", "created_date").write.mode("overwrite").options(**BLOOM_OPTIONS).partitionBy("created_date")
     .parquet(f"{path}/append={append}"))


def publish(spark: SparkSession, path: str, append: str, info: Mapping[str, int] | None = None) -> None:
    """Commit a staged append by writing its manifest row."""
    rows = spark.read.schema(_schema("created_date date")).parquet(f"{path}/append={append}")
    decisions = F.map_from_arrays(F.array(*[F.lit(d) for d in DECISIONS]),
                                  F.array(*[F.count_if(F.col("decision") == d) for d in DECISIONS]))
    days = rows.groupBy("created_date").agg(
        F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
        decisions.alias("decisions"))
    kept = F.create_map(*[x for k, v in (info or {}).items() for x in (F.lit(k), F.lit(int(v)).cast("bigint"))]) \
        if info else F.create_map().cast("map<string,bigint>")
    # One row; its days are those of one append.
    row = days.agg(F.array_sort(F.collect_list(F.struct("created_date", "n", "oldest", "newest"))).alias("z"),
                   F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.col("created_date").cast("string"), F.lit("")), "decisions"))).alias("d"))
    zone = F.transform("z", lambda z: F.struct(
        z["created_date"].alias("created_date"), z["n"].alias("n"), z["oldest"].alias("oldest"), z["newest"].alias("newest"),
        F.col("d")[F.coalesce(z["created_date"].cast("string"), F.lit(""))].alias("decisions")))
    (row.select(zone.alias("zones"), kept.alias("info")).coalesce(1)
     .write.mode("overwrite").parquet(f"{manifest_path(path)}/append={append}"))


def append(rows: DataFrame, path: str, append_id: str, info: Mapping[str, int] | None = None) -> bool:
    """Stage and publish; False if this append has been published before."""
    spark = rows.sparkSession
    if is_published(spark, path, append_id):
        return False
    stage(rows, path, append_id)
    publish(spark, path, append_id, info)
    return True


def published(data: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``data`` (with the partition column ``append``) whose append is committed."""
    return data.join(manifest(spark, path).select("append"), "append", "left_semi")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All published rows."""
    schema = _schema("created_date date, append string")
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return published(spark.read.schema(schema).parquet(path), spark, path)


def _schema(extra: str) -> T.StructType:
    return T.StructType([*AUDIT.fields, *T.StructType.fromDDL(extra).fields])


def newest(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The ``limit`` newest published rows (ties on created_at: larger id first).

    Zones whose oldest row is newest come first until they hold ``limit``
    rows; the last of them bounds the answer from below, and only zones that
    reach that bound are opened.  At most ``limit`` zones come to the driver
    for the bound, as each has a row.
    """
    if not 1 <= limit <= MAX_RECENT:
        raise ValueError(f"limit must be in 1..{MAX_RECENT}, got {limit}")
    z = zones(spark, path)
    since, held = None, 0
    for r in z.filter("oldest IS NOT NULL").orderBy(F.desc("oldest")).select("oldest", "n").limit(limit).collect():
        held += r.n
        if held >= limit:
            since = r.oldest
            break
    if since is not None:
        z = z.filter(F.col("newest") >= F.lit(since))
    folders = z.select("append", "created_date").limit(MAX_FOLDERS + 1).collect()
    if not folders:
        return spark.createDataFrame([], _schema("created_date date, append string"))
    if len(folders) <= MAX_FOLDERS:
        day = lambda d: "__HIVE_DEFAULT_PARTITION__" if d is None else d.isoformat()
        rows = (spark.read.schema(_schema("created_date date, append string")).option("basePath", path)
                .parquet(*[f"{path}/append={r.append}/created_date={day(r.created_date)}" for r in folders]))
    else:
        rows = read(spark, path)
        if since is not None:
            rows = rows.filter(F.col("created_date") >= F.to_date(F.lit(since)))
    if since is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(since))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def decision_totals(spark: SparkSession, path: str) -> DataFrame:
    """(created_date, decision, n) of the whole log, from the manifest alone."""
    return (zones(spark, path).select("created_date", F.explode("decisions").alias("decision", "n"))
            .groupBy("created_date", "decision").agg(F.sum("n").alias("n")).filter("n > 0"))
