"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from txsentry.session import scratch_path


def col(name: str) -> Column:
    """Column by its exact name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame | Iterable[str], *bases: str) -> list[str]:
    """Helper column names that ``df`` does not use (case-insensitively)."""
    used = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for base in bases:
        name = base
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[Column]:
    """All columns of ``df`` but those that an operator is about to add."""
    drop = {n.lower() for n in names}
    return [col(c) for c in df.columns if c.lower() not in drop]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def owned_scratch() -> Iterator[list[str]]:
    """The paths of all tables that ``written`` makes inside, so that their
    owner can drop them when what was computed from them has been stored."""
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield paths
    finally:
        _owned.reset(token)


def drop_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder, written with ``options``.

    Cuts the lineage: row ids given before the write stay as they are, and a
    lost executor only costs a reread.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (owned := _owned.get()) is not None:
        owned.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs started inside:
    whole texts are long rows, and a batch is held by Spark and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, keys: list[Column], group: str | None, out: str, name: str) -> DataFrame:
    """``df`` plus ``out``: gapless position from 0 in the order of ``keys``
    (within ``group``, which must then be the first key).

    One range shuffle; rows with equal keys may be split over partitions by
    their place in the scan, so no key is too frequent.  The sorted rows are
    written once; only one row per (group, partition) is ranked afterwards.
    """
    spark = df.sparkSession
    scan, pos, part, first, base = fresh(df, "_scan", "_pos", "_part", "_first", "_base")
    df = df.withColumn(scan, F.monotonically_increasing_id())
    order = [*keys, F.col(scan)]
    ranged = (df.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
              .withColumn(pos, F.monotonically_increasing_id()).drop(scan))
    rows = (written(ranged, name)
            .withColumn(part, F.shiftright(F.col(pos), 33)).withColumn(pos, F.col(pos).bitwiseAND((1 << 33) - 1)))
    by = [F.lit(0) if group is None else col(group)]
    g = "_g"
    while g in df.columns:
        g += "_"
    sizes = rows.groupBy(by[0].alias(g), F.col(part)).agg(F.count("*").alias("n"), F.min(pos).alias(first))
    w = Window.partitionBy(g).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    p2 = part + "2"
    # The partitions are sorted by group, so there are at most partitions +
    # groups of these rows; callers pass no or a fixed number of groups.
    sizes = F.broadcast(sizes.select(g, F.col(part).alias(p2), first, F.coalesce(F.sum("n").over(w), F.lit(0)).alias(base)))
    on = (F.col(part) == F.col(p2)) & (by[0].eqNullSafe(F.col(g)))
    return (rows.join(sizes, on, "left")
            .withColumn(out, F.col(base) + F.col(pos) - F.col(first))
            .drop(g, p2, first, base, part, pos))
