"""Table with at most one row per key, and its quarantine.

The table is a directory of buckets: a row lies in ``bucket = hash(key) mod
buckets``, so a new batch is compared with the buckets that its own keys fall
into and no others (partition pruning), on the key (Parquet keeps Bloom
filters of it for point lookups).  Every insert writes the rows it adds and
the rows it refuses, each with its reason, and then one manifest row, which
commits both: an insert that died before it is invisible and may be repeated,
one that has it adds nothing when it is sent again.

Refused are rows without a key, rows that lost against a later one of the same
key in the batch, and rows whose key is stored already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentry.operators import audit_log as L
from txsentry.operators.scratch import stored

BUCKETS = 64
MISSING, REPEATED, STORED = "missing key", "repeated in batch", "stored before"


def quarantine_path(path: str) -> str:
    return path.rstrip("/") + "-quarantine"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _with(schema: T.StructType, extra: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(extra).fields])


def judge(rows: DataFrame, existing: DataFrame | None, key: str, order: str) -> DataFrame:
    """``rows`` with ``reason``: null for those to insert.

    The winner of a key is its latest row by ``order`` (ties: largest row, then
    the later in the batch), found by a partial aggregate, so a key with
    millions of rows is one row per task.
    """
    return _judged(_numbered(rows), existing, key, order)


def _numbered(rows: DataFrame) -> DataFrame:
    """The batch, written once with a number per row; all later steps read this."""
    return stored(rows.withColumn("_row", F.monotonically_increasing_id()), "keyed-batch")


def _judged(numbered: DataFrame, existing: DataFrame | None, key: str, order: str) -> DataFrame:
    others = [c for c in numbered.columns if c not in (key, order, "_row")]
    best = (numbered.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.max(F.struct(order, *others, "_row"))["_row"].alias("_best")))
    if existing is not None:
        held = existing.select(F.col(key).alias("_held")).distinct()
        best = best.join(held, F.col(key) == F.col("_held"), "left")
    else:
        best = best.withColumn("_held", F.lit(None).cast("string"))
    verdict = best.select(F.col("_best"), F.col("_held").isNotNull().alias("_stored"))
    reason = (F.when(F.col(key).isNull(), MISSING).when(F.col("_best").isNull(), REPEATED)
              .when(F.col("_stored"), STORED))
    return (numbered.join(verdict, F.col("_row") == F.col("_best"), "left")
            .withColumn("reason", reason).drop("_row", "_best", "_stored"))


def insert(rows: DataFrame, path: str, append_id: str, key: str = "transaction_id", order: str = "created_at",
           buckets: int = BUCKETS) -> bool:
    """Add the new keys of ``rows``; False if this insert was made before."""
    spark = rows.sparkSession
    if L.is_published(spark, path, append_id):
        return False
    placed = _numbered(rows.withColumn("bucket", _bucket(F.col(key), buckets)))
    existing = None
    if L.exists(spark, path):
        touched = [r.bucket for r in placed.filter(F.col(key).isNotNull()).select("bucket").distinct().collect()]    # at most `buckets`
        existing = read(spark, path, rows.schema).filter(F.col("bucket").isin(touched))
    judged = stored(_judged(placed, existing, key, order), "keyed-judged")
    (judged.filter("reason IS NULL").drop("reason").write.mode("overwrite")
     .option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(f"{path}/append={append_id}"))
    judged.filter("reason IS NOT NULL").drop("bucket").write.mode("overwrite").parquet(f"{quarantine_path(path)}/append={append_id}")
    counts = {r.reason or "stored": r["count"] for r in judged.groupBy("reason").count().collect()}      # at most four
    manifest = spark.range(1).select(F.lit(None).cast(f"array<{L.ZONE}>").alias("zones"), F.create_map(
        *[x for k, v in counts.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]).cast("map<string,bigint>").alias("info"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{L.manifest_path(path)}/append={append_id}")
    return True


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All committed rows (``schema`` of the inserted rows, plus ``append`` and ``bucket``)."""
    return L.published(spark.read.schema(_with(schema, "append string, bucket int")).parquet(path), spark, path)


def quarantine(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All refused rows of committed inserts, with their ``reason``."""
    if not L.exists(spark, quarantine_path(path)):
        return spark.createDataFrame([], _with(schema, "reason string, append string"))
    data = spark.read.schema(_with(schema, "reason string, append string")).parquet(quarantine_path(path))
    return L.published(data, spark, path)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(outcome, n) over all committed inserts, from the manifest alone."""
    return (L.manifest(spark, path).select(F.explode("info").alias("outcome", "n"))
            .groupBy("outcome").agg(F.sum("n").alias("n")))


def lookup(spark: SparkSession, path: str, schema: T.StructType, value: str, key: str = "transaction_id", buckets: int = BUCKETS) -> DataFrame:
    """The row of one key: one bucket is opened, and Bloom filters skip its other files."""
    bucket = spark.range(1).select(_bucket(F.lit(value), buckets)).first()[0]
    return read(spark, path, schema).filter((F.col("bucket") == bucket) & (F.col(key) == value))
