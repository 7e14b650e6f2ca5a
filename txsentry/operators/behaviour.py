"""Behavioural deviation detection against per-user profiles.

Profiles are grouped aggregates (map-side partial aggregation, so a heavy
user costs one small buffer per task, not one task).  Detections join the
profile back on ``user_id``: the profile grows with the user count, so no
broadcast is forced; AQE broadcasts it at run time when it is small and
otherwise splits skewed sort-merge partitions.  Only the fixed lookup
tables (channel map, country/city list bounded by the two-letter country
domain) are broadcast explicitly.  Sequence signals (B6, B9, B10) use the
skew-safe bucketed operators of ``txsentry.operators.sequence``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsentry.functions.features import event_hour, is_night
from txsentry.operators import sequence as S
from txsentry.operators.joins import broadcast_if_small, null_safe_join
from txsentry.operators.scratch import stored
from txsentry.operators.stats import exact_median
from txsentry.schema import DEVICE_CHANNELS, DEVICE_CHANNELS_DEFAULT, FRAUD_PATTERNS

# Fixed detection thresholds (multiples of the user's baseline amount).
SPIKE_FACTOR = 5.0
NIGHT_TRANSFER_FACTOR = 8.0
TAKEOVER_FACTOR = 4.0
TOP_CITIES = 2
TOP_CATEGORIES = 3
VELOCITY_WINDOW_MINUTES = 15
VELOCITY_MIN_COUNT = 3
BURST_GAP_MINUTES = 4
BURST_MIN_SIZE = 3
TRAVEL_HOURS = 24
FLAG_MIN_SIGNALS = 2


def user_profile(tx: DataFrame, baseline: str = "mean", normal_only: bool = False) -> DataFrame:
    """Per user: home country and primary device (most frequent value, ties
    to the smallest), baseline amount and row count.

    ``baseline``: "mean", "median" (approximate percentile, one pass) or
    "median_exact" (ranks selected from counts of values: a heavy user is no
    single task).  ``normal_only`` computes the baseline
    over label-0 rows only.
    """
    amount = F.col("amount")
    if normal_only:
        amount = F.when(F.col("is_fraud") == 0, amount)
    aggs = [F.mode("country", deterministic=True).alias("home_country"),
            F.mode("device_type", deterministic=True).alias("primary_device")]
    if baseline == "mean":
        aggs.append(F.avg(amount).alias("avg_amount"))
    elif baseline == "median":
        aggs.append(F.percentile_approx(amount, 0.5, 10000).cast("double").alias("avg_amount"))
    aggs.append(F.count(F.lit(1)).alias("n_tx"))
    profile = tx.groupBy("user_id").agg(*aggs)
    if baseline == "median_exact":
        rows = tx if not normal_only else tx.filter(F.col("is_fraud") == 0)
        med = exact_median(rows, ["user_id"], "amount")
        profile = null_safe_join(profile, med.withColumnRenamed("median", "avg_amount"),
                                 ["user_id"], "left")
    return profile


def user_top_values(tx: DataFrame, column: str, k: int) -> DataFrame:
    """Per user the ``k`` most frequent values of ``column`` (count desc,
    value asc): user_id, rank, <column>, n.  The window runs over the
    already aggregated (user, value) rows, at most one per distinct value."""
    counts = tx.groupBy("user_id", column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col(column))
    return (counts.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k).select("user_id", "rank", column, "n"))


def with_profile(tx: DataFrame, profile: DataFrame) -> DataFrame:
    return tx.join(profile, "user_id")


def _ratio() -> Column:
    return F.col("amount") / F.col("avg_amount")


def amount_spike(tx: DataFrame, profile: DataFrame, factor: float = SPIKE_FACTOR) -> DataFrame:
    return with_profile(tx, profile).filter(F.col("amount") >= factor * F.col("avg_amount"))


def night_transfer(tx: DataFrame, profile: DataFrame,
                   factor: float = NIGHT_TRANSFER_FACTOR) -> DataFrame:
    night = is_night(event_hour(F.col("timestamp"))) == 1
    return (with_profile(tx, profile)
            .filter(F.col("transaction_type").isin("transfer", "withdrawal") & night
                    & (F.col("amount") >= factor * F.col("avg_amount"))))


def international_jump(tx: DataFrame, profile: DataFrame) -> DataFrame:
    return with_profile(tx, profile).filter(F.col("country") != F.col("home_country"))


def device_takeover(tx: DataFrame, profile: DataFrame, factor: float = TAKEOVER_FACTOR) -> DataFrame:
    return with_profile(tx, profile).filter(
        (F.col("device_type") != F.col("primary_device"))
        & (F.col("amount") >= factor * F.col("avg_amount")))


def unusual_merchant(tx: DataFrame, top_categories: DataFrame) -> DataFrame:
    """Rows whose category is not among the user's top categories.  A missing
    category, and a missing user, is a value like any other, as in ``signals``."""
    keys = top_categories.select(F.col("user_id").alias("_u"), F.col("merchant_category").alias("_c"))
    known = F.col("user_id").eqNullSafe(F.col("_u")) & F.col("merchant_category").eqNullSafe(F.col("_c"))
    return tx.join(keys, known, "left_anti")


def impossible_travel(tx: DataFrame, hours: float = TRAVEL_HOURS,
                      bucket_seconds: int = S.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Rows whose country differs from the user's previous row within ``hours``
    (``lag_within`` with the travel window as horizon)."""
    seq = S.lag_within(tx, "user_id", "timestamp", "transaction_id", ["country"],
                       int(hours * 3600), bucket_seconds)
    gap = F.unix_micros("timestamp") - F.unix_micros("prev_timestamp")
    return (seq.filter(F.col("prev_country").isNotNull()
                       & (F.col("country") != F.col("prev_country")))
               .withColumn("gap_minutes", gap / F.lit(60_000_000.0)))


def velocity(tx: DataFrame, window_minutes: int = VELOCITY_WINDOW_MINUTES,
             min_count: int = VELOCITY_MIN_COUNT,
             bucket_seconds: int = S.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Rows with at least ``min_count`` rows of the same user in the trailing window."""
    counted = S.trailing_count(tx, "user_id", "timestamp", window_minutes * 60,
                               "n_window", bucket_seconds)
    return counted.filter(F.col("n_window") >= min_count)


def burst_sessions(tx: DataFrame, gap_minutes: int = BURST_GAP_MINUTES,
                   min_size: int = BURST_MIN_SIZE,
                   bucket_seconds: int = S.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Runs of one user's rows with gaps <= ``gap_minutes`` and at least
    ``min_size`` rows: user_id, session_start, session_end, n_tx,
    n_merchants, total_amount.  One pass over the rows
    (``sequence.session_summaries``)."""
    s = S.session_summaries(tx, "user_id", "timestamp", "transaction_id", gap_minutes * 60,
                            "amount", "merchant_id", bucket_seconds)
    return (s.withColumnsRenamed({"n_distinct": "n_merchants", "total": "total_amount"})
             .filter(F.col("n_tx") >= min_size))


def channel_allowed(device: Column, channel: Column) -> Column:
    """Whether ``channel`` is plausible for ``device`` (literal map, no join)."""
    m = F.create_map(*[x for d, chans in DEVICE_CHANNELS.items()
                       for x in (F.lit(d), F.array(*[F.lit(c) for c in chans]))])
    allowed = F.coalesce(m[device], F.array(*[F.lit(c) for c in DEVICE_CHANNELS_DEFAULT]))
    return F.array_contains(allowed, channel)


def channel_mismatch(tx: DataFrame) -> DataFrame:
    return tx.filter(~channel_allowed(F.col("device_type"), F.col("channel")))


def geo_mismatch(tx: DataFrame, geo: DataFrame) -> DataFrame:
    """Rows whose (country, city) is not a known pair.  The reference list is
    a dimension (two-letter countries times their cities): broadcast after a
    row-count check, a normal anti join beyond it."""
    return tx.join(broadcast_if_small(geo.select("country", "city")), ["country", "city"],
                   "left_anti")


def profile_by_category(tx: DataFrame, k: int = TOP_CATEGORIES) -> DataFrame:
    """One row per (user, category) the user has used: the user's profile
    columns plus ``is_top`` (the category is among the user's ``k`` most
    frequent).

    The feed is read once, into counts and sums by (user, category, country,
    device); that table is written, and the modes, the average and the top
    categories are rolled up from it.  So the fact table meets profile and top
    categories in a single join on (user, category)."""
    base = stored(tx.groupBy("user_id", "merchant_category", "country", "device_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.count("amount").alias("amounts")), "profile-base")

    def mode(column: str, out: str) -> DataFrame:
        """Most frequent value per user, ties to the smallest, missing values left out."""
        counts = base.groupBy("user_id", column).agg(F.sum("n").alias("n"))
        best = F.min(F.when(F.col(column).isNotNull(), F.struct((-F.col("n")).alias("neg"), F.col(column).alias("v"))))
        return counts.groupBy("user_id").agg(best["v"].alias(out))

    totals = base.groupBy("user_id").agg((F.sum("total") / F.sum("amounts")).alias("avg_amount"), F.sum("n").alias("n_tx"))
    profile = null_safe_join(null_safe_join(totals, mode("country", "home_country"), ["user_id"]),
                             mode("device_type", "primary_device"), ["user_id"])
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col("merchant_category"))
    ranked = (base.groupBy("user_id", "merchant_category").agg(F.sum("n").alias("n"))
              .select("user_id", "merchant_category", (F.row_number().over(w) <= k).cast("int").alias("is_top")))
    return null_safe_join(ranked, profile, ["user_id"])


def signals(tx: DataFrame, window_minutes: int = VELOCITY_WINDOW_MINUTES,
            bucket_seconds: int = S.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Every row with the six deviation signals as 0/1 columns and the
    pattern predicates needed for labelling.  The fact table is shuffled
    twice: once for the trailing counts (by user and time bucket) and once
    for the join to ``profile_by_category``."""
    dim = profile_by_category(tx)
    counted = S.trailing_count(tx, "user_id", "timestamp", window_minutes * 60,
                               "n_window", bucket_seconds)
    x = null_safe_join(counted, dim, ["user_id", "merchant_category"])
    ratio = _ratio()
    night = is_night(event_hour(F.col("timestamp"))) == 1
    def flag(cond):  # a comparison with a missing value is no deviation
        return F.coalesce(cond.cast("int"), F.lit(0))

    return x.select(
        "*",
        flag(ratio >= SPIKE_FACTOR).alias("sig_amount"),
        flag(night).alias("sig_night"),
        flag(F.col("country") != F.col("home_country")).alias("sig_country"),
        flag(F.col("device_type") != F.col("primary_device")).alias("sig_device"),
        (1 - F.col("is_top")).alias("sig_merchant"),
        flag(F.col("n_window") >= VELOCITY_MIN_COUNT).alias("sig_velocity"),
    ).drop("is_top")


_SIGNALS = ["sig_amount", "sig_night", "sig_country", "sig_device", "sig_merchant",
            "sig_velocity"]


def deviation_count(sig: DataFrame, min_signals: int = FLAG_MIN_SIGNALS) -> DataFrame:
    n = sum((F.col(s) for s in _SIGNALS[1:]), F.col(_SIGNALS[0]))
    return sig.withColumn("n_signals", n) \
              .withColumn("flagged", (F.col("n_signals") >= min_signals).cast("int"))


def pattern_label(counted: DataFrame) -> DataFrame:
    """Flagged rows named by the first matching fraud pattern (priority
    order of FRAUD_PATTERNS); flagged rows matching none are "unclassified"."""
    ratio = _ratio()
    night = F.col("sig_night") == 1
    preds = {
        "high_amount_spike": ratio >= SPIKE_FACTOR,
        "night_transfer": F.col("transaction_type").isin("transfer", "withdrawal") & night
                          & (ratio >= NIGHT_TRANSFER_FACTOR),
        "international_jump": F.col("sig_country") == 1,
        "device_takeover": (F.col("sig_device") == 1) & (ratio >= TAKEOVER_FACTOR),
        "unusual_merchant": F.col("sig_merchant") == 1,
        "rapid_sequence": F.col("sig_velocity") == 1,
    }
    expr = None
    for name in FRAUD_PATTERNS:
        expr = F.when(preds[name], name) if expr is None else expr.when(preds[name], name)
    return counted.filter(F.col("flagged") == 1) \
                  .withColumn("pattern", expr.otherwise("unclassified"))


def pattern_mix(labelled: DataFrame) -> DataFrame:
    """Rows and share per pattern (share of all flagged rows).  One partial
    aggregate of conditional counts over the fixed pattern names, unpivoted;
    patterns with no row are left out."""
    names = FRAUD_PATTERNS + ["unclassified"]
    counts = labelled.agg(*[F.count_if(F.col("pattern") == p).alias(p) for p in names])
    total = " + ".join(f"`{p}`" for p in names)
    pairs = ", ".join(f"'{p}', `{p}`, round(`{p}` / ({total}), 6)" for p in names)
    return (counts.selectExpr(f"stack({len(names)}, {pairs}) AS (pattern, n, share)")
                  .filter(F.col("n") > 0))
