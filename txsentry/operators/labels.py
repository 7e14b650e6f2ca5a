"""Distributed dictionary encoding of text columns.

Fit: distinct labels with their counts are sorted over all tasks (range
partitions); a label's code is its place in its partition plus the labels of
the partitions before, so no task and not the driver holds a column's labels.
The dictionary is a table in the shared folder, partitioned by column.

Encode: a left join per column.  A dictionary whose text is at most
``BROADCAST_BYTES`` (summed exactly at fit) is broadcast.  A larger one is
joined in two steps: the labels that hold at least 1/``SHARES`` of the fitted
rows (so at most ``SHARES`` of them) by broadcast, and the rows with any other
label by a shuffle on the label, where no fitted label is more frequent than
that share.  Labels that the fit has not seen, and nulls, get ``UNSEEN``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txsentry.operators.scratch import stored

UNSEEN = -1
SHARES = 1000
BROADCAST_BYTES = 8 << 20
DICTIONARY = "label string, code bigint, n bigint, column string"


def rank_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, label, code, n): sorted distinct labels of each column,
    numbered from 0, with the rows that have them."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    counts = (df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, label)").filter("label IS NOT NULL")
              .groupBy("column", "label").agg(F.count(F.lit(1)).alias("n")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (counts.repartitionByRange(parts, "column", "label").sortWithinPartitions("column", "label")
              .withColumn("_at", F.monotonically_increasing_id()))
    rows = stored(ranged, "labels-sorted").withColumn("_part", F.shiftright("_at", 33))
    # One row per (column, partition): its labels, and those in partitions before.
    sizes = rows.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_k"), F.min("_at").alias("_first"))
    before = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("column", "_part", "_first", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_base"))
    return (rows.join(sizes, ["column", "_part"])
            .select("column", "label", (F.col("_at") - F.col("_first") + F.col("_base")).alias("code"), "n"))


def fit(df: DataFrame, columns: list[str], path: str) -> dict[str, dict[str, int]]:
    """Write the dictionary of ``columns`` to ``path``; per column its labels,
    their bytes and the rows fitted."""
    rank_labels(df, columns).write.mode("overwrite").partitionBy("column").parquet(path)
    sums = read(df.sparkSession, path).groupBy("column").agg(
        F.count(F.lit(1)).alias("labels"), F.sum(F.coalesce(F.octet_length("label"), F.lit(0)) + 16).alias("bytes"), F.sum("n").alias("rows"))
    found = {r["column"]: {"labels": r["labels"], "bytes": r["bytes"], "rows": r["rows"]} for r in sums.collect()}   # a row per column
    return {c: found.get(c, {"labels": 0, "bytes": 0, "rows": 0}) for c in columns}


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(DICTIONARY).parquet(path)


def encode(df: DataFrame, path: str, sizes: dict[str, dict[str, int]], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with every column of ``sizes`` replaced by its code."""
    spark = df.sparkSession
    for c, size in sizes.items():
        if not size["labels"]:
            df = df.withColumn(c, F.lit(UNSEEN).cast("bigint"))
            continue
        words = read(spark, path).filter(F.col("column") == c)
        codes = words.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        if size["bytes"] <= broadcast_bytes:
            out = df.join(F.broadcast(codes), F.col(c) == F.col("_label"), "left")
        else:
            hot = words.filter(F.col("n") * SHARES >= size["rows"]).select(F.col("label").alias("_hot"), F.col("code").alias("_hotcode"))
            out = df.join(F.broadcast(hot), F.col(c) == F.col("_hot"), "left")
            # Rows that are coded already do not look for a label: a null key stays where it is.
            rest = F.when(F.col("_hot").isNull(), F.col(c))
            out = out.withColumn("_key", rest).join(codes, F.col("_key") == F.col("_label"), "left").withColumn(
                "_code", F.coalesce("_hotcode", "_code")).drop("_hot", "_hotcode", "_key")
        df = out.withColumn(c, F.coalesce("_code", F.lit(UNSEEN))).drop("_label", "_code")
    return df
