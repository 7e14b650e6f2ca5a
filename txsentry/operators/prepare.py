"""Dataset preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsentry.operators.stats import KEY_RANGE, group_positions, portable_key
from txsentry.schema import LABELLED_ORDER

POSITIVE_WEIGHT = 10.0  # weight of class 1 for the boosted trees


def union_labelled(*parts: DataFrame) -> DataFrame:
    """Bag union by column name (no dedup, no shuffle)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def order_key(df: DataFrame, seed: int = 42, numeric_id: Column | None = None) -> Column:
    """Seeded pseudo-random key: portable integer mix of a numeric id when
    given, else xxhash64 of the whole row."""
    if numeric_id is not None:
        return portable_key(numeric_id, seed)
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])


def shuffle_rows(df: DataFrame, seed: int = 42, numeric_id: Column | None = None) -> DataFrame:
    """Seeded permutation: a distributed range sort on the order key."""
    return df.withColumn("shuffle_key", order_key(df, seed, numeric_id)).orderBy("shuffle_key")


def sample_n(df: DataFrame, n: int, seed: int = 42, numeric_id: Column | None = None) -> DataFrame:
    """Fixed-size seeded sample: the n smallest order keys (a top-k, each
    task keeps only its own n best rows)."""
    return df.withColumn("shuffle_key", order_key(df, seed, numeric_id)) \
             .orderBy("shuffle_key").limit(n)


def stratified_split(df: DataFrame, label: str = "is_fraud", test_fraction: float = 0.2,
                     seed: int = 42, numeric_id: Column | None = None,
                     tiebreak: str = "transaction_id") -> DataFrame:
    """Add ``is_test``: per label the ceil(test_fraction * n) rows with the
    smallest order keys.  Exact per-class sizes; the per-label ranking is a
    distributed sort, not one task per label."""
    keyed = df.withColumn("_key", order_key(df, seed, numeric_id))
    # Both key kinds are uniform over a known range: equal-width buckets.
    key_range = KEY_RANGE if numeric_id is not None else (-(1 << 63), (1 << 63) - 1)
    pos = group_positions(keyed, [label], ["_key", tiebreak], uniform_range=key_range)
    cut = F.ceil(F.lit(test_fraction) * F.col("_n"))
    return pos.withColumn("is_test", (F.col("_pos") < cut).cast("int")).drop("_key", "_pos", "_n")


def enforce_types(df: DataFrame) -> DataFrame:
    """Labelled file layout: amount to cents, boolean flags (missing: false),
    int label (missing: 0), fixed order."""
    return df.select(
        *[F.round("amount", 2).alias("amount") if c == "amount"
          else F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c)
          if c in ("is_international", "card_present")
          else F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) if c == "is_fraud"
          else F.col(c) for c in LABELLED_ORDER])


def class_weights(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Per class (0/1): count, balanced weight n / (2 n_c) and the fixed
    positive weight.  One aggregate of two conditional counts, unpivoted."""
    c = df.agg(F.count_if(F.col(label) == 0).alias("n0"),
               F.count_if(F.col(label) == 1).alias("n1"))
    rows = c.selectExpr(f"stack(2, 0, n0, n0 + n1, 1, n1, n0 + n1) AS ({label}, n, total)")
    return (rows.filter(F.col("n") > 0)
            .select(F.col(label).cast("int").alias(label), "n",
                    (F.col("total") / (2.0 * F.col("n"))).alias("balanced_weight"),
                    F.when(F.col(label) == 1, POSITIVE_WEIGHT).otherwise(1.0)
                     .alias("scale_weight")))


def with_weights(df: DataFrame, label: str = "is_fraud", mode: str = "scale") -> DataFrame:
    """Attach a ``weight`` column for ML training (class counts are a
    two-row table, joined as a broadcast).  Rows whose label is null or no
    class keep a null weight: they are no training rows."""
    w = class_weights(df, label).select(
        label, F.col("scale_weight" if mode == "scale" else "balanced_weight").alias("weight"))
    return df.join(F.broadcast(w), label, "left")
