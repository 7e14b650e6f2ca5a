"""Per-key event-sequence operators that stay balanced under key skew.

A plain ``Window.partitionBy(user)`` sends every row of a user to one task,
so one heavy user (say a third of all rows) becomes one giant sort.  These
operators partition by ``(key, time bucket)`` instead, so a heavy key spreads
over as many tasks as it has buckets, and repair the bucket edges exactly:

* ``lag_in_sequence``  previous row per key (bucket edge: previous non-empty
  bucket's last row, from a small per-bucket summary)
* ``lag_within``       previous row per key if it is at most a horizon earlier
  (one shuffle when the horizon fits in a bucket: the bucket's last horizon
  is copied into the next bucket; else two, the buckets' last rows being
  copied into the buckets that the horizon spans)
* ``trailing_count``   rows per key in a trailing RANGE frame (the tail of
  each bucket is copied into the next one as context rows; windows longer
  than a bucket are differences of two running counts)
* ``sessions``         gap-and-island sessions (islands crossing bucket edges
  are stitched through a per-bucket summary)

Summaries hold one row per (key, non-empty bucket) and are built with
map-side partial aggregation.  The bucket width is a parameter and bounds the
rows of one (key, bucket) in a task; ``bucket_seconds="auto"`` picks the widest width whose
fullest (key, bucket) stays under a row target, from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsentry.operators.scratch import stored

DEFAULT_BUCKET_SECONDS = 6 * 3600
# Candidate widths for ``choose_bucket_seconds`` (widest first).
BUCKET_CANDIDATES = [24 * 3600, 6 * 3600, 3600, 900, 300, 60]
TARGET_ROWS_PER_BUCKET = 2_000_000
SUPER_BUCKETS = 4096      # buckets of one step of a prefix sum over buckets


def choose_bucket_seconds(df: DataFrame, key: str, ts: str, min_seconds: int = 0,
                          target_rows: int = TARGET_ROWS_PER_BUCKET) -> int:
    """The widest candidate bucket width whose fullest (key, bucket) holds at
    most ``target_rows`` rows (never narrower than ``min_seconds``, the
    window or horizon the operator needs).  One job: rows per (key, minute)
    by partial aggregation, each of those rows re-bucketed per candidate,
    and the largest bucket per candidate (a handful of numbers collected)."""
    usable = [c for c in BUCKET_CANDIDATES if c >= max(min_seconds, 60)]
    if not usable:
        return max(int(min_seconds), 60)
    fine = df.groupBy(key, F.floor(_micros(ts) / F.lit(60_000_000)).alias("_min")) \
             .agg(F.count(F.lit(1)).alias("_n"))
    cand = F.explode(F.array(*[F.lit(c // 60) for c in usable])).alias("_w")
    per = (fine.select(key, "_min", "_n", cand)
               .groupBy("_w", key, F.floor(F.col("_min") / F.col("_w")).alias("_b"))
               .agg(F.sum("_n").alias("_s")))
    maxima = {r["_w"] * 60: r["_m"] for r in
              per.groupBy("_w").agg(F.max("_s").alias("_m")).collect()}
    for c in usable:                  # widest first
        if maxima.get(c, 0) <= target_rows:
            return c
    return usable[-1]


def _resolve_bucket(df: DataFrame, key: str, ts: str, bucket_seconds, min_seconds: int = 0) -> int:
    if bucket_seconds == "auto":
        return choose_bucket_seconds(df, key, ts, min_seconds)
    return int(bucket_seconds)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def _bucket(ts: str, bucket_us: int) -> Column:
    return F.floor(_micros(ts) / F.lit(bucket_us)).cast("bigint")


def lag_in_sequence(df: DataFrame, key: str, ts: str, order_tiebreak: str,
                    cols: list[str], bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
                    prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<ts>`` and ``prev_<c>`` for each of ``cols``: the values of
    the previous row of the same key in (ts, tiebreak) order (null for the
    first row of a key)."""
    bucket_seconds = _resolve_bucket(df, key, ts, bucket_seconds)
    bucket_us = int(bucket_seconds * 1_000_000)
    carried = [ts, order_tiebreak] + [c for c in cols if c not in (ts, order_tiebreak)]
    b = df.withColumn("_bucket", _bucket(ts, bucket_us))
    w = Window.partitionBy(key, "_bucket").orderBy(ts, order_tiebreak)
    inner = b.withColumns({f"_lag_{c}": F.lag(c).over(w) for c in carried}) \
             .withColumn("_first", F.row_number().over(w) == 1)
    # Last row of each non-empty bucket, then the previous bucket's last row.
    last = (b.groupBy(key, "_bucket")
             .agg(F.max(F.struct(*[F.col(c) for c in carried])).alias("_last")))
    wb = Window.partitionBy(key).orderBy("_bucket")
    edge = last.select(key, "_bucket", F.lag("_last").over(wb).alias("_edge"))
    joined = inner.join(edge, [key, "_bucket"], "left")
    out = {f"{prefix}{c}": F.when(F.col("_first"), F.col("_edge")[c])
                            .otherwise(F.col(f"_lag_{c}"))
           for c in [ts] + [c for c in cols if c != ts]}
    return joined.withColumns(out).drop(
        "_bucket", "_first", "_edge", *[f"_lag_{c}" for c in carried])


def lag_within(df: DataFrame, key: str, ts: str, order_tiebreak: str, cols: list[str],
               horizon_seconds: int, bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
               prefix: str = "prev_") -> DataFrame:
    """Like ``lag_in_sequence`` but only a previous row at most
    ``horizon_seconds`` earlier counts (else the ``prev_`` values are null).

    When the horizon fits in a bucket this is one pass and one shuffle: the
    last ``horizon`` of each bucket is copied into the next bucket as context,
    so a predecessor inside the horizon is always in the row's window (if the
    true predecessor is older than the copied context it is outside the
    horizon anyway).  A longer horizon does not widen the buckets, whose width
    bounds the rows of a heavy key per task: the predecessor of a bucket's
    first row is the last row of one of the buckets that the horizon spans,
    so only the last row of each bucket is copied, into each of these
    (``_lag_over_buckets``: two shuffles, one read of the input)."""
    bucket_seconds = _resolve_bucket(df, key, ts, bucket_seconds)
    h_us = int(horizon_seconds * 1_000_000)
    bucket_us = int(bucket_seconds * 1_000_000)
    out_cols = [ts] + [c for c in cols if c != ts]
    if h_us > bucket_us:
        return _lag_over_buckets(df, key, ts, order_tiebreak, out_cols, h_us, bucket_us, prefix)
    m = _micros(ts)
    b = _bucket(ts, bucket_us)
    tail = m >= (b + 1) * F.lit(bucket_us) - F.lit(h_us)
    offsets = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = df.withColumns({"_m": m, "_b": b}).withColumn("_ctx", F.explode(offsets)) \
          .withColumn("_b", F.col("_b") + F.col("_ctx"))
    w = Window.partitionBy(key, "_b").orderBy(ts, order_tiebreak)
    lagged = x.withColumns({"_prev_m": F.lag("_m").over(w),
                            **{f"_lag_{c}": F.lag(c).over(w) for c in out_cols}})
    inside = (F.col("_m") - F.col("_prev_m")) <= h_us
    return (lagged.filter(F.col("_ctx") == 0)
                  .withColumns({f"{prefix}{c}": F.when(inside, F.col(f"_lag_{c}"))
                                for c in out_cols})
                  .drop("_m", "_b", "_ctx", "_prev_m", *[f"_lag_{c}" for c in out_cols]))


def _lag_over_buckets(df: DataFrame, key: str, ts: str, tiebreak: str, out_cols: list[str], h_us: int,
                      bucket_us: int, prefix: str) -> DataFrame:
    """``lag_within`` for horizons longer than a bucket.  Inside a bucket every
    row but the first has its predecessor; then the buckets' last rows meet the
    rows of the ``horizon / bucket`` (rounded up) buckets that follow, where
    the newest of them precedes the first row."""
    span = -(-h_us // bucket_us)
    carried = [ts, tiebreak] + [c for c in out_cols if c not in (ts, tiebreak)]
    x = df.withColumns({"_m": _micros(ts), "_b": _bucket(ts, bucket_us)})
    w = Window.partitionBy(key, "_b").orderBy(ts, tiebreak)
    x = x.withColumns({"_before": F.lag(F.struct("_m", *carried)).over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    offsets = F.when(F.col("_last") & F.col("_b").isNotNull(), F.sequence(F.lit(0), F.lit(span))).otherwise(F.array(F.lit(0)))
    x = x.withColumn("_ctx", F.explode(offsets)).withColumn("_at", F.col("_b") + F.col("_ctx"))
    # Rows copied from earlier buckets sort before the bucket's own.
    w2 = Window.partitionBy(key, "_at").orderBy(ts, tiebreak)
    x = x.withColumn("_earlier", F.lag(F.struct("_m", *carried)).over(w2)).filter(F.col("_ctx") == 0)
    prev = F.coalesce("_before", "_earlier")
    inside = (F.col("_m") - prev["_m"]) <= h_us
    return (x.withColumns({f"{prefix}{c}": F.when(inside, prev[c]) for c in out_cols})
             .drop("_m", "_b", "_before", "_last", "_ctx", "_at", "_earlier"))


def _count_by_probes(df: DataFrame, key: str, ts: str, w_us: int, bucket_us: int, out: str) -> DataFrame:
    """``trailing_count`` for windows longer than a bucket: the rows of a key
    up to t less its rows before t - window.  Both are counted inside the
    bucket where t, or the probe t - window, lies, on top of the sizes of all
    earlier buckets, which are summed in two steps; so no task holds more of a
    key than a bucket, however long the window is."""
    points = df.groupBy(key, _micros(ts).alias("_m")).agg(F.count(F.lit(1)).alias("_c"))
    timed = points.filter("_m IS NOT NULL")
    ends = (timed.select(key, F.col("_m").alias("_row"), F.explode(F.array(
                F.struct(F.col("_m").alias("_p"), F.col("_c").alias("_n"), F.lit(1).alias("_sign")),
                F.struct((F.col("_m") - w_us).alias("_p"), F.lit(0).cast("long").alias("_n"), F.lit(-1).alias("_sign")))).alias("_e"))
            .select(key, "_row", "_e.*").withColumn("_b", F.floor(F.col("_p") / F.lit(bucket_us))))
    ends = stored(ends, "trailing-ends")
    sizes = ends.groupBy(key, "_b").agg(F.sum("_n").alias("_size")).withColumn("_s", F.floor(F.col("_b") / SUPER_BUCKETS))
    steps = Window.partitionBy(key, "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    supers = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    above = (sizes.groupBy(key, "_s").agg(F.sum("_size").alias("_t"))
             .select(F.col(key).alias("_k1"), F.col("_s").alias("_s1"), F.coalesce(F.sum("_t").over(supers), F.lit(0)).alias("_far")))
    sizes = sizes.withColumn("_near", F.coalesce(F.sum("_size").over(steps), F.lit(0)))
    base = (sizes.join(above, F.col(key).eqNullSafe(F.col("_k1")) & (F.col("_s") == F.col("_s1")))
            .select(F.col(key).alias("_k"), F.col("_b").alias("_bb"), (F.col("_near") + F.col("_far")).alias("_base")))
    inside = Window.partitionBy(key, "_b").orderBy("_p")
    upto, under = (F.sum("_n").over(inside.rangeBetween(Window.unboundedPreceding, last)) for last in (0, -1))
    counted = (ends.withColumn("_in", F.coalesce(F.when(F.col("_sign") > 0, upto).otherwise(under), F.lit(0)))
               .join(base, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_bb")))
               .groupBy(F.col(key).alias("_k"), F.col("_row").alias("_m"))
               .agg(F.sum(F.col("_sign") * (F.col("_base") + F.col("_in"))).alias(out)))
    # Rows without a time are peers of each other.
    untimed = points.filter("_m IS NULL").select(F.col(key).alias("_k"), "_m", F.col("_c").alias(out))
    every = counted.unionByName(untimed).withColumnRenamed("_m", "_mm")
    rows = df.withColumn("_m", _micros(ts))
    return (rows.join(every, F.col(key).eqNullSafe(F.col("_k")) & F.col("_m").eqNullSafe(F.col("_mm")))
            .select(*df.columns, out))


def trailing_count(df: DataFrame, key: str, ts: str, window_seconds: int,
                   out: str = "n_window", bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Rows of the same key with time in [ts - window, ts] (peers included).

    A window that fits in a bucket is one pass: the tail of each bucket is
    copied into the next.  A longer one does not widen the buckets but goes by
    ``_count_by_probes``."""
    bucket_seconds = _resolve_bucket(df, key, ts, bucket_seconds)
    w_us = int(window_seconds * 1_000_000)
    bucket_us = int(bucket_seconds * 1_000_000)
    if w_us > bucket_us:
        return _count_by_probes(df, key, ts, w_us, bucket_us, out)
    m = _micros(ts)
    b = _bucket(ts, bucket_us)
    # Rows in the last `window` of their bucket are also context for the next.
    tail = m >= (b + 1) * F.lit(bucket_us) - F.lit(w_us)
    offsets = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = df.withColumns({"_m": m, "_b": b}).withColumn("_ctx", F.explode(offsets)) \
          .withColumn("_b", F.col("_b") + F.col("_ctx"))
    w = Window.partitionBy(key, "_b").orderBy("_m").rangeBetween(-w_us, 0)
    return (x.withColumn(out, F.count(F.lit(1)).over(w))
             .filter(F.col("_ctx") == 0).drop("_m", "_b", "_ctx"))


def sessions(df: DataFrame, key: str, ts: str, order_tiebreak: str, gap_seconds: int,
             out: str = "session_start", bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Add ``session_start``: the time of the first row of the row's session,
    where a session is a run of rows of one key with consecutive gaps of at
    most ``gap_seconds``.  (key, session_start) identifies a session."""
    bucket_seconds = _resolve_bucket(df, key, ts, bucket_seconds)
    gap_us = int(gap_seconds * 1_000_000)
    bucket_us = int(bucket_seconds * 1_000_000)
    x = df.withColumns({"_m": _micros(ts), "_b": _bucket(ts, bucket_us)})
    w = Window.partitionBy(key, "_b").orderBy("_m", order_tiebreak)
    prev = F.lag("_m").over(w)
    x = x.withColumn("_prev", prev)
    # Starts inside the bucket (not counting the bucket's first row).
    x = x.withColumn("_istart", F.when(F.col("_prev").isNotNull()
                                       & (F.col("_m") - F.col("_prev") > gap_us), F.col("_m")))
    x = x.withColumn("_run_start", F.max("_istart").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summary = x.groupBy(key, "_b").agg(F.min("_m").alias("_first"), F.max("_m").alias("_lastm"),
                                       F.max("_istart").alias("_last_istart"))
    wb = Window.partitionBy(key).orderBy("_b")
    prev_last = F.lag("_lastm").over(wb)
    summary = summary.withColumn(
        "_cont", F.coalesce(F.col("_first") - prev_last <= gap_us, F.lit(False)))
    summary = summary.withColumn(
        "_reset", F.coalesce(F.col("_last_istart"),
                             F.when(~F.col("_cont"), F.col("_first"))))
    summary = summary.withColumn("_eff_last", F.last("_reset", ignorenulls=True).over(
        wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summary = summary.select(key, "_b", F.when(F.col("_cont"), F.lag("_eff_last").over(wb))
                             .otherwise(F.col("_first")).alias("_first_island"))
    y = x.join(summary, [key, "_b"], "left")
    start_us = F.coalesce(F.col("_run_start"), F.col("_first_island"))
    return y.withColumn(out, F.timestamp_micros(start_us)).drop(
        "_m", "_b", "_prev", "_istart", "_run_start", "_first_island")


def session_summaries(df: DataFrame, key: str, ts: str, order_tiebreak: str,
                      gap_seconds: int, amount: str, distinct_of: str,
                      bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Per session (rows of one key with consecutive gaps of at most
    ``gap_seconds``): key, session_start, session_end, n_tx, n_distinct (of
    ``distinct_of``) and total (sum of ``amount``).

    One pass and one shuffle of the input: inside (key, bucket) windows —
    the last ``gap`` of the previous bucket copied in as context — every
    session start is exact; rows are aggregated into segments (a session's
    part inside one bucket, by value of ``distinct_of``) on the same
    partitioning; segments that continue an earlier session are resolved on
    the segment table, and segment partials are combined into sessions by
    partial aggregates, without any list of values."""
    bucket_seconds = _resolve_bucket(df, key, ts, bucket_seconds, gap_seconds)
    gap_us = int(gap_seconds * 1_000_000)
    bucket_us = max(int(bucket_seconds * 1_000_000), gap_us)
    x = df.select(key, order_tiebreak, amount, distinct_of, _micros(ts).alias("_m"),
                  _bucket(ts, bucket_us).alias("_b"))
    tail = F.col("_m") >= (F.col("_b") + 1) * F.lit(bucket_us) - F.lit(gap_us)
    offsets = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = (x.withColumn("_ctx", F.explode(offsets))
           .withColumn("_b", F.col("_b") + F.col("_ctx")))
    w = Window.partitionBy(key, "_b").orderBy("_m", order_tiebreak)
    own = F.col("_ctx") == 0
    prev = F.lag("_m").over(w)
    x = x.withColumn("_is_start", own & (prev.isNull() | (F.col("_m") - prev > gap_us)))
    start_ts = F.when(F.col("_is_start"), F.col("_m"))
    x = x.withColumns({
        # latest start at or before the row inside the bucket (null: the row
        # continues a session from an earlier bucket)
        "_sstart": F.max(start_ts).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_last_start": F.max(start_ts).over(Window.partitionBy(key, "_b")),
    }).filter(own)
    # Segments (a session's part inside one bucket) by value of ``distinct_of``,
    # grouped on keys the data is already partitioned by; written once, as
    # they feed two consumers below.
    parts = stored(x.groupBy(key, "_b", "_sstart", distinct_of).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_amt"), F.max("_m").alias("_end"),
        F.max("_last_start").alias("_last_start")), "session-parts")
    # Per bucket: the start of the session its last row belongs to.
    wb = Window.partitionBy(key).orderBy("_b")
    buckets = parts.groupBy(key, "_b").agg(F.max("_last_start").alias("_last_start"))
    buckets = buckets.withColumn("_eff", F.last("_last_start", ignorenulls=True).over(
        wb.rowsBetween(Window.unboundedPreceding, 0)))
    buckets = buckets.select(F.col(key).alias("_k"), F.col("_b").alias("_bb"), F.lag("_eff").over(wb).alias("_head_start"))
    resolved = (parts.join(buckets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_bb")))
                .withColumn("_start", F.coalesce("_sstart", "_head_start")))
    # One row per (session, value), then one per session: values are counted, never listed.
    values = resolved.groupBy(key, "_start", distinct_of).agg(
        F.sum("_n").alias("_n"), F.sum("_amt").alias("_amt"), F.max("_end").alias("_end"))
    return (values.groupBy(key, "_start")
            .agg(F.max("_end").alias("_end"), F.sum("_n").alias("n_tx"), F.count(distinct_of).alias("n_distinct"),
                 F.sum("_amt").alias("total"))
            .select(key, F.timestamp_micros("_start").alias("session_start"),
                    F.timestamp_micros("_end").alias("session_end"),
                    "n_tx", "n_distinct", "total"))
