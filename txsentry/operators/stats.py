"""Exact order statistics without a per-group task.

``Window.partitionBy(label).orderBy(key)`` or an exact ``median`` put a
whole group into one task (one buffer); with a group holding a third of the
rows that is a third of the data in one task.  Here rows are first cut into
value buckets (boundaries: approximate quantiles of the order column,
computed once and kept as literals), ranked inside (group, bucket) windows,
and shifted by the sizes of the earlier buckets of their group (a small
per-(group, bucket) table).  A large group is spread over all buckets, and
because the boundaries are literals every re-evaluation of the plan (task
retry, lost executor) gives the same buckets and positions.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txsentry.operators.joins import null_safe_join
from txsentry.operators.scratch import stored

MIN_BUCKETS = 256
MAX_BUCKETS = 100_000
MAX_ACCURACY = 20_000


def default_buckets(df: DataFrame) -> int:
    """Value buckets scale with the configured parallelism (which is sized for
    the data): twice the shuffle partitions, at least 256."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKETS, min(MAX_BUCKETS, 2 * parts))


KEY_RANGE = (0, 2147483647)  # portable_key values lie in [0, 2^31 - 1)


def portable_key(x, seed: int = 42):
    """Deterministic pseudo-random order key of a BIGINT id (two Lehmer steps
    modulo 2^31-1, seeded).  Integer arithmetic only, so any SQL engine
    computes the same key."""
    p, a = 2147483647, 48271
    k = (((F.pmod(x, F.lit(p)) + F.lit(seed)) % p) * a) % p
    return (((k + F.lit(seed * 7919)) % p) * a) % p


def value_buckets(df: DataFrame, column: str, out: str = "_vb",
                  n_buckets: int | None = None,
                  uniform_range: tuple[int, int] | None = None) -> DataFrame:
    """Add ``out``: the index of ``column``'s value among approximate
    quantile boundaries (monotone in the value; the column must be non-null).
    For a column known to be uniform over ``uniform_range`` (a seeded hash
    key) the buckets are equal-width slices: no pass over the data."""
    n_buckets = n_buckets or default_buckets(df)
    if uniform_range is not None:
        lo, hi = uniform_range
        width = float(hi - lo) / n_buckets
        # Double arithmetic: monotone in the value and free of BIGINT overflow.
        pos = (F.col(column).cast("double") - F.lit(float(lo))) / F.lit(width)
        return df.withColumn(out, F.least(F.floor(pos), F.lit(n_buckets - 1)).cast("int"))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    # Sketch accuracy is capped: per-task sketch memory grows with it, and
    # coarser boundaries only make buckets unequal, never positions wrong.
    accuracy = min(4 * n_buckets, MAX_ACCURACY)
    row = df.agg(F.percentile_approx(F.col(column).cast("double"), probs, accuracy)
                 .alias("q")).first()
    qs = sorted({float(v) for v in (row["q"] or []) if v is not None})
    splits = [float("-inf")] + qs + [float("inf")]
    tmp = df.withColumn("_vb_in", F.col(column).cast("double"))
    out_df = Bucketizer(splits=splits, inputCol="_vb_in", outputCol=out,
                        handleInvalid="keep").transform(tmp)
    return out_df.withColumn(out, F.col(out).cast("int")).drop("_vb_in")


def group_positions(df: DataFrame, group: list[str], order: list[str],
                    n_buckets: int | None = None,
                    uniform_range: tuple[int, int] | None = None) -> DataFrame:
    """Add ``_pos`` (0-based position of the row in its group, in ``order``;
    ``order`` must make rows unique, its first column numeric) and ``_n``
    (group size).  A null group is a group.  The offset table has one row per
    (group, bucket); Spark broadcasts it where its size allows."""
    b = value_buckets(df, order[0], "_vb", n_buckets, uniform_range)
    w = Window.partitionBy(*group, "_vb").orderBy(*order)
    local = b.withColumn("_lpos", F.row_number().over(w) - 1)
    sizes = b.groupBy(*group, "_vb").agg(F.count(F.lit(1)).alias("_cnt"))
    wg = Window.partitionBy(*group)
    offsets = sizes.select(*group, "_vb",
                           (F.sum("_cnt").over(wg.orderBy("_vb")) - F.col("_cnt")).alias("_off"),
                           F.sum("_cnt").over(wg).alias("_n"))
    out = null_safe_join(local, offsets, [*group, "_vb"])
    return out.withColumn("_pos", F.col("_off") + F.col("_lpos")) \
              .drop("_vb", "_lpos", "_off")


SKETCH = 10_000            # rank error of the first bracket: 1/SKETCH of a group
TASK_VALUES = 1_000_000    # distinct values that one task sorts at the end
SPLITS = 1024              # parts that an over-full bracket is cut into


def exact_median(df: DataFrame, group: list[str], value: str, extra: tuple = ()) -> DataFrame:
    """Per group the median of the non-null ``value``s (mean of the two middle
    values for an even count), exact, beside the aggregates ``extra``.  Groups
    without values are left out, or have a null median if there are extras.

    Selection by narrowing intervals, with two reads of ``df``.  The first one
    has a mergeable sketch per group, whose quantiles next to the middle
    bracket the wanted ranks.  The second counts, per group, the rows below the
    bracket and the rows of each value inside it, with partial sums, so neither
    a large group nor a frequent value is a single task.  Whether the bracket
    holds the ranks is checked (a group where it does not gets its whole
    range), so the result does not depend on the sketch.  A bracket with more
    than ``TASK_VALUES`` values is cut into ``SPLITS`` parts, of which those
    with the ranks stay, until it has fewer; this reads the counts only."""
    v, names = F.col(value), {g: f"_g_{g}" for g in group}
    keys = [F.col(g).alias(n) for g, n in names.items()]
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in names.items()]
    q = [0.5 - 2 / SKETCH, 0.5 + 2 / SKETCH]
    base = stored(df.groupBy(*group).agg(
        F.count(v).alias("_n"), F.percentile_approx(v, q, SKETCH).alias("_q"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        *extra), "median-groups")
    want = base.filter("_n > 0").select(*keys, F.floor((F.col("_n") - 1) / 2).alias("_first"), F.ceil((F.col("_n") - 1) / 2).alias("_second"),
                                        F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"), "_min", "_max")

    def counted(brackets: DataFrame) -> DataFrame:
        """Rows per value inside the bracket; one row of null value for those below it."""
        inside = F.when(v >= F.col("_lo"), v)
        rows = df.filter(v.isNotNull()).join(brackets, same).filter(v <= F.col("_hi"))
        return stored(rows.groupBy(*names.values(), inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "median-counts")

    def sums(counts: DataFrame) -> DataFrame:
        return counts.groupBy(*names.values()).agg(
            F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_below"),
            F.sum("_c").alias("_upto"), F.count("_v").alias("_values"))

    counts = counted(want)
    state = null_safe_join(want, sums(counts), list(names.values()), "left")
    held = F.coalesce((F.col("_below") <= F.col("_first")) & (F.col("_second") < F.col("_upto")), F.lit(False))
    missed = stored(state.filter(~held).select(*names.values(), "_first", "_second", F.col("_min").alias("_lo"), F.col("_max").alias("_hi")), "median-missed")
    if missed.head(1):
        good = state.filter(held).select(*[F.col(n).alias(n + "k") for n in names.values()])
        on = [F.col(n).eqNullSafe(F.col(n + "k")) for n in names.values()]
        counts = stored(counts.join(good, on, "left_semi").unionByName(counted(missed)), "median-counts")

    ranks = want.select(*names.values(), "_first", "_second")
    most, before = sums(counts).agg(F.max("_values")).first()[0] or 0, None
    while most > TASK_VALUES and most != before:        # the widest bracket, as long as it shrinks
        counts, before = _narrowed(counts, ranks, list(names.values())), most
        most = sums(counts).agg(F.max("_values")).first()[0]
    by = Window.partitionBy(*names.values()).orderBy(F.col("_v").asc_nulls_first())
    to = F.sum("_c").over(by)
    at = null_safe_join(counts.withColumn("_to", to), ranks, list(names.values()))

    def holds(rank):
        return ((F.col(rank) >= F.col("_to") - F.col("_c")) & (F.col(rank) < F.col("_to"))).cast("int")

    middle = (at.withColumn("_k", holds("_first") + holds("_second")).filter("_k > 0 AND _v IS NOT NULL")
              .groupBy(*names.values()).agg((F.sum(F.col("_v") * F.col("_k")) / 2).alias("median")))
    back = middle.withColumnsRenamed({n: f"{n}_" for n in names.values()})
    on = [F.col(g).eqNullSafe(F.col(f"{n}_")) for g, n in names.items()]
    return base.join(back, on, "left" if extra else "inner").drop("_n", "_q", "_min", "_max", *[f"{n}_" for n in names.values()])


def _narrowed(counts: DataFrame, ranks: DataFrame, names: list[str]) -> DataFrame:
    """``counts`` with the bracket of every group cut to the part of it that
    holds the wanted ranks (to the values on both sides of the cut, if the two
    ranks lie in two parts); what lies below is added to the row of null value."""
    inside = counts.filter("_v IS NOT NULL")
    span = inside.groupBy(*names).agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    part = F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_z") - F.col("_a")) * SPLITS), F.lit(SPLITS - 1))
    part = F.when(F.col("_z") > F.col("_a"), part).otherwise(F.lit(0))
    parted = null_safe_join(counts, span, names, "left").withColumn("_part", F.when(F.col("_v").isNull(), -1).otherwise(part))
    w = Window.partitionBy(*names).orderBy("_part")
    sizes = (parted.groupBy(*names, "_part").agg(F.sum("_c").alias("_s"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
             .withColumn("_t", F.sum("_s").over(w)))
    held = null_safe_join(sizes, ranks, names).filter("_t > _first AND _t - _s <= _second")     # parts from the first rank's to the second's
    both = F.min("_part") < F.max("_part")
    edges = stored(held.groupBy(*names).agg(
        F.when(both, F.min_by("_mx", "_part")).otherwise(F.min("_mn")).alias("_lo"),
        F.when(both, F.max_by("_mn", "_part")).otherwise(F.max("_mx")).alias("_hi")), "median-edges")
    cut = null_safe_join(counts, edges, names)
    kept = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    return stored(cut.filter("_v IS NULL OR _v <= _hi").groupBy(*names, kept.alias("_v")).agg(F.sum("_c").alias("_c")), "median-counts")


def prefix_sum(df: DataFrame, order: list[str], value: str, out: str = "_cum",
               n_buckets: int | None = None) -> DataFrame:
    """Add ``out``: running (inclusive) sum of ``value`` in ``order``
    (``order`` must make rows unique, its first column numeric).  Running
    sums are per value bucket; each bucket then adds the totals of the
    earlier buckets (one row per bucket, broadcast)."""
    b = value_buckets(df, order[0], "_vb", n_buckets)
    w = (Window.partitionBy("_vb").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = b.withColumn("_local", F.sum(value).over(w))
    totals = b.groupBy("_vb").agg(F.sum(value).alias("_btotal"))
    # One row per value bucket (at most MAX_BUCKETS): the running total over
    # buckets is a single small task by construction.
    offsets = totals.select("_vb", (F.sum("_btotal").over(Window.orderBy("_vb"))
                                    - F.col("_btotal")).alias("_boff"))
    return (local.join(F.broadcast(offsets), "_vb")
            .withColumn(out, F.col("_local") + F.coalesce(F.col("_boff"), F.lit(0)))
            .drop("_vb", "_local", "_boff"))
