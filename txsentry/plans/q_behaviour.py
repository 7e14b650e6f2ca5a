"""Registered behavioural-detection queries (B1-B14) over the labelled feed.

Where a default finds next to nothing on the test data (velocity 15 min,
bursts 4 min) the registered query uses a wider setting; the defaults stay
in the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from txsentry.operators import behaviour as B
from txsentry.plans.catalog import query
from txsentry.plans.oracle import sround, with_views
from txsentry.sources.tables import geo_dim, transactions

_TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_TS_FMT_SQL = "'%Y-%m-%d %H:%M:%S.%f'"

_PROFILE = """
profile AS (
 SELECT u.user_id, hc.country AS home_country, pd.device_type AS primary_device,
        u.avg_amount, u.n_tx
 FROM (SELECT user_id, avg(amount) AS avg_amount, count(*) AS n_tx
       FROM transactions GROUP BY user_id) u
 JOIN (SELECT user_id, country FROM (
         SELECT user_id, country, row_number() OVER (PARTITION BY user_id
                ORDER BY count(*) DESC, country) AS rk
         FROM transactions GROUP BY user_id, country) a WHERE rk = 1) hc USING (user_id)
 JOIN (SELECT user_id, device_type FROM (
         SELECT user_id, device_type, row_number() OVER (PARTITION BY user_id
                ORDER BY count(*) DESC, device_type) AS rk
         FROM transactions GROUP BY user_id, device_type) b WHERE rk = 1) pd USING (user_id)
)"""


def _top_sql(name: str, column: str, k: int) -> str:
    return f"""
{name} AS (
 SELECT user_id, CAST(rk AS INT) AS rank, {column}, n FROM (
   SELECT user_id, {column}, count(*) AS n,
          row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {column}) AS rk
   FROM transactions GROUP BY user_id, {column}) t
 WHERE rk <= {k})"""


_JOINED = "joined AS (SELECT t.*, p.home_country, p.primary_device, p.avg_amount " \
          "FROM transactions t JOIN profile p USING (user_id))"
_NIGHT_SQL = "(hour(timestamp) >= 22 OR hour(timestamp) < 6)"


def _tx(spark, sf_dir):
    return transactions(spark, sf_dir)


@query("user_profile", with_views(f"""
SELECT user_id, home_country, primary_device, {sround('avg_amount', 6)} AS avg_amount, n_tx
FROM profile""", _PROFILE))
def q_user_profile(spark, sf_dir):
    p = B.user_profile(_tx(spark, sf_dir))
    return p.withColumn("avg_amount", F.round("avg_amount", 6))


@query("user_top_cities", with_views("SELECT * FROM topcity",
                                     _top_sql("topcity", "city", B.TOP_CITIES)))
def q_user_top_cities(spark, sf_dir):
    return B.user_top_values(_tx(spark, sf_dir), "city", B.TOP_CITIES)


@query("user_top_categories", with_views("SELECT * FROM topcat",
                                         _top_sql("topcat", "merchant_category",
                                                  B.TOP_CATEGORIES)))
def q_user_top_categories(spark, sf_dir):
    return B.user_top_values(_tx(spark, sf_dir), "merchant_category", B.TOP_CATEGORIES)


@query("amount_spike", with_views("""
SELECT transaction_id, user_id, amount FROM joined WHERE amount >= 5 * avg_amount""",
                                  _PROFILE, _JOINED))
def q_amount_spike(spark, sf_dir):
    t = _tx(spark, sf_dir)
    return B.amount_spike(t, B.user_profile(t)).select("transaction_id", "user_id", "amount")


@query("night_transfer", with_views(f"""
SELECT transaction_id, user_id, amount FROM joined
WHERE transaction_type IN ('transfer', 'withdrawal') AND {_NIGHT_SQL}
  AND amount >= 8 * avg_amount""", _PROFILE, _JOINED))
def q_night_transfer(spark, sf_dir):
    t = _tx(spark, sf_dir)
    return B.night_transfer(t, B.user_profile(t)).select("transaction_id", "user_id", "amount")


@query("international_jump", with_views("""
SELECT transaction_id, country, home_country FROM joined WHERE country <> home_country""",
                                        _PROFILE, _JOINED))
def q_international_jump(spark, sf_dir):
    t = _tx(spark, sf_dir)
    return B.international_jump(t, B.user_profile(t)).select(
        "transaction_id", "country", "home_country")


@query("impossible_travel", with_views(f"""
SELECT transaction_id, prev_country, country,
       {sround('(epoch_us(timestamp) - epoch_us(prev_ts)) / 60000000.0', 3)} AS gap_minutes
FROM (SELECT *, lag(country) OVER w AS prev_country, lag(timestamp) OVER w AS prev_ts
      FROM transactions WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, transaction_id)) x
WHERE prev_country IS NOT NULL AND country <> prev_country
  AND epoch_us(timestamp) - epoch_us(prev_ts) <= CAST({B.TRAVEL_HOURS} AS BIGINT) * 3600 * 1000000"""))
def q_impossible_travel(spark, sf_dir):
    return B.impossible_travel(_tx(spark, sf_dir), B.TRAVEL_HOURS).select(
        "transaction_id", "prev_country", "country",
        F.round("gap_minutes", 3).alias("gap_minutes"))


@query("device_takeover", with_views("""
SELECT transaction_id, device_type, primary_device FROM joined
WHERE device_type <> primary_device AND amount >= 4 * avg_amount""", _PROFILE, _JOINED))
def q_device_takeover(spark, sf_dir):
    t = _tx(spark, sf_dir)
    return B.device_takeover(t, B.user_profile(t)).select(
        "transaction_id", "device_type", "primary_device")


@query("unusual_merchant", with_views("""
SELECT transaction_id, user_id, merchant_category FROM transactions t
WHERE NOT EXISTS (SELECT 1 FROM topcat c WHERE c.user_id = t.user_id
                  AND c.merchant_category = t.merchant_category)""",
                                      _top_sql("topcat", "merchant_category", 3)))
def q_unusual_merchant(spark, sf_dir):
    t = _tx(spark, sf_dir)
    top = B.user_top_values(t, "merchant_category", B.TOP_CATEGORIES)
    return B.unusual_merchant(t, top).select("transaction_id", "user_id", "merchant_category")


_VELOCITY_MINUTES = 360


_VELOCITY_SQL = with_views(f"""
SELECT transaction_id, n_window FROM (
  SELECT transaction_id, count(*) OVER (PARTITION BY user_id ORDER BY timestamp
         RANGE BETWEEN INTERVAL {_VELOCITY_MINUTES} MINUTES PRECEDING AND CURRENT ROW) AS n_window
  FROM transactions) x
WHERE n_window >= 3""")


@query("velocity", _VELOCITY_SQL)
def q_velocity(spark, sf_dir):
    return B.velocity(_tx(spark, sf_dir), _VELOCITY_MINUTES, 3).select(
        "transaction_id", "n_window")


@query("velocity_narrow_buckets", _VELOCITY_SQL)
def q_velocity_narrow_buckets(spark, sf_dir):
    """The same six hours over buckets of ten minutes: no task holds more of a user."""
    return B.velocity(_tx(spark, sf_dir), _VELOCITY_MINUTES, 3, bucket_seconds=600).select(
        "transaction_id", "n_window")


_BURST_GAP = 120


@query("burst_sessions", with_views(f"""
SELECT user_id, strftime(min(timestamp), {_TS_FMT_SQL}) AS session_start,
       strftime(max(timestamp), {_TS_FMT_SQL}) AS session_end,
       count(*) AS n_tx, count(DISTINCT merchant_id) AS n_merchants,
       {sround('sum(amount)', 2)} AS total_amount
FROM (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY timestamp, transaction_id
                              ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL
                 OR epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) > CAST({_BURST_GAP} AS BIGINT) * 60000000
                 THEN 1 ELSE 0 END AS st
            FROM transactions
            WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, transaction_id)) a) b
GROUP BY user_id, sid HAVING count(*) >= 3"""))
def q_burst_sessions(spark, sf_dir):
    s = B.burst_sessions(_tx(spark, sf_dir), _BURST_GAP, 3)
    return s.select("user_id",
                    F.date_format("session_start", _TS_FMT).alias("session_start"),
                    F.date_format("session_end", _TS_FMT).alias("session_end"),
                    "n_tx", "n_merchants", F.round("total_amount", 2).alias("total_amount"))


@query("channel_mismatch", with_views("""
SELECT transaction_id, device_type, channel FROM transactions
WHERE NOT (CASE device_type WHEN 'mobile' THEN channel IN ('mobile_app', 'online')
                            WHEN 'desktop' THEN channel IN ('online', 'call_center')
                            WHEN 'tablet' THEN channel IN ('mobile_app', 'online')
                            WHEN 'pos_terminal' THEN channel IN ('in_store', 'atm')
                            ELSE channel = 'online' END)"""))
def q_channel_mismatch(spark, sf_dir):
    return B.channel_mismatch(_tx(spark, sf_dir)).select("transaction_id", "device_type", "channel")


@query("geo_mismatch", with_views("""
SELECT transaction_id, country, city FROM transactions t
WHERE NOT EXISTS (SELECT 1 FROM geo_dim g WHERE g.country = t.country AND g.city = t.city)""",
                                  views=("geo_dim",)))
def q_geo_mismatch(spark, sf_dir):
    return B.geo_mismatch(_tx(spark, sf_dir), geo_dim(spark, sf_dir)).select(
        "transaction_id", "country", "city")


_SIGNALS_SQL = f"""
signals AS (
 SELECT j.*, CAST(amount >= 5 * avg_amount AS INT) AS sig_amount,
   CAST({_NIGHT_SQL} AS INT) AS sig_night,
   CAST(country <> home_country AS INT) AS sig_country,
   CAST(device_type <> primary_device AS INT) AS sig_device,
   CAST(NOT EXISTS (SELECT 1 FROM topcat c WHERE c.user_id = j.user_id
                    AND c.merchant_category = j.merchant_category) AS INT) AS sig_merchant,
   CAST(count(*) OVER (PARTITION BY user_id ORDER BY timestamp
        RANGE BETWEEN INTERVAL {B.VELOCITY_WINDOW_MINUTES} MINUTES PRECEDING AND CURRENT ROW)
        >= 3 AS INT) AS sig_velocity
 FROM joined j),
counted AS (
 SELECT *, sig_amount + sig_night + sig_country + sig_device + sig_merchant + sig_velocity
           AS n_signals
 FROM signals),
labelled AS (
 SELECT transaction_id, CASE
   WHEN amount >= 5 * avg_amount THEN 'high_amount_spike'
   WHEN transaction_type IN ('transfer', 'withdrawal') AND sig_night = 1
        AND amount >= 8 * avg_amount THEN 'night_transfer'
   WHEN sig_country = 1 THEN 'international_jump'
   WHEN sig_device = 1 AND amount >= 4 * avg_amount THEN 'device_takeover'
   WHEN sig_merchant = 1 THEN 'unusual_merchant'
   WHEN sig_velocity = 1 THEN 'rapid_sequence'
   ELSE 'unclassified' END AS pattern
 FROM counted WHERE n_signals >= 2)"""

_SIG_CTES = (_PROFILE, _JOINED, _top_sql("topcat", "merchant_category", 3), _SIGNALS_SQL)


def _counted(spark, sf_dir):
    return B.deviation_count(B.signals(_tx(spark, sf_dir)))


@query("deviation_count", with_views("""
SELECT transaction_id, n_signals, CAST(n_signals >= 2 AS INT) AS flagged FROM counted""",
                                     *_SIG_CTES))
def q_deviation_count(spark, sf_dir):
    return _counted(spark, sf_dir).select("transaction_id", "n_signals", "flagged")


@query("pattern_label", with_views("SELECT transaction_id, pattern FROM labelled", *_SIG_CTES))
def q_pattern_label(spark, sf_dir):
    return B.pattern_label(_counted(spark, sf_dir)).select("transaction_id", "pattern")


@query("pattern_mix", with_views(f"""
SELECT pattern, n, {sround('n / sum(n) OVER ()', 6)} AS share
FROM (SELECT pattern, count(*) AS n FROM labelled GROUP BY pattern) x""", *_SIG_CTES))
def q_pattern_mix(spark, sf_dir):
    return B.pattern_mix(B.pattern_label(_counted(spark, sf_dir)))
