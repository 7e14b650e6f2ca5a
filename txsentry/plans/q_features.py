"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from txsentry.operators import features as ops
from txsentry.plans.catalog import query
from txsentry.plans.oracle import with_views
from txsentry.schema import CATEGORICAL_COLS, FEATURE_COLUMNS, SCALED_COLS
from txsentry.sources.tables import raw_transactions, transactions

_TRUE = "'true','t','1','yes','y','on'"


def _base_sql(source: str, raw: bool) -> str:
    """DuckDB form of base_features over ``source`` (raw text or typed)."""
    if raw:
        amt = "TRY_CAST(amount AS DOUBLE)"
        ts = "TRY_CAST(timestamp AS TIMESTAMP)"
        flags = [f"CAST(coalesce(lower(trim({b})) IN ({_TRUE}), false) AS INT) AS {b}"
                 for b in ("is_international", "card_present")]
    else:
        amt, ts = "amount", "timestamp"
        flags = [f"CAST(coalesce({b}, false) AS INT) AS {b}"
                 for b in ("is_international", "card_present")]
    cats = [f"coalesce(CAST({c} AS VARCHAR), 'unknown') AS {c}" for c in CATEGORICAL_COLS]
    return f"""
base0 AS (
SELECT transaction_id,
  greatest(coalesce({amt}, 0.0), 0.0) AS amount,
  CAST(coalesce(hour({ts}), 0) AS INT) AS hour,
  CAST(coalesce(isodow({ts}) - 1, 0) AS INT) AS day_of_week,
  {', '.join(flags)},
  {', '.join(cats)}
FROM {source}),
base AS (
SELECT *, ln(1 + amount) AS amount_log, CAST(day_of_week >= 5 AS INT) AS is_weekend,
  CAST(hour >= 22 OR hour < 6 AS INT) AS is_night_transaction
FROM base0)"""


def _raw_sql(body: str, *ctes: str) -> str:
    return with_views(body, _base_sql("raw_transactions", True), *ctes,
                      views=("raw_transactions",))


def _raw_base(spark, sf_dir):
    return ops.base_features(raw_transactions(spark, sf_dir))


@query("amount_clean", _raw_sql("SELECT transaction_id, amount FROM base"))
def q_amount_clean(spark, sf_dir):
    return _raw_base(spark, sf_dir).select("transaction_id", "amount")


@query("amount_log", _raw_sql("SELECT transaction_id, round(amount_log, 6) AS amount_log FROM base"))
def q_amount_log(spark, sf_dir):
    return _raw_base(spark, sf_dir).select("transaction_id",
                                           F.round("amount_log", 6).alias("amount_log"))


@query("event_hour", _raw_sql("SELECT transaction_id, hour FROM base"))
def q_event_hour(spark, sf_dir):
    return _raw_base(spark, sf_dir).select("transaction_id", "hour")


@query("day_of_week", _raw_sql("SELECT transaction_id, day_of_week FROM base"))
def q_day_of_week(spark, sf_dir):
    return _raw_base(spark, sf_dir).select("transaction_id", "day_of_week")


@query("is_weekend", _raw_sql("SELECT transaction_id, is_weekend FROM base"))
def q_is_weekend(spark, sf_dir):
    return _raw_base(spark, sf_dir).select("transaction_id", "is_weekend")


@query("is_night", _raw_sql("SELECT transaction_id, is_night_transaction FROM base"))
def q_is_night(spark, sf_dir):
    return _raw_base(spark, sf_dir).select("transaction_id", "is_night_transaction")


@query("temporal_now", with_views("""
SELECT transaction_id, 10 AS hour, 5 AS day_of_week, 1 AS is_weekend, 0 AS is_night_transaction
FROM transactions"""))
def q_temporal_now(spark, sf_dir):
    # The feed without its timestamp column: time features come from the
    # run's default time (here a fixed Saturday 10:00 UTC for repeatability).
    no_ts = transactions(spark, sf_dir).drop("timestamp")
    return ops.base_features(no_ts, default_ts="2026-03-21 10:00:00").select(
        "transaction_id", "hour", "day_of_week", "is_weekend", "is_night_transaction")


@query("bool_norm", _raw_sql("SELECT transaction_id, is_international, card_present FROM base"))
def q_bool_norm(spark, sf_dir):
    return _raw_base(spark, sf_dir).select("transaction_id", "is_international", "card_present")


@query("category_fill", _raw_sql(
    f"SELECT transaction_id, {', '.join(CATEGORICAL_COLS)} FROM base"))
def q_category_fill(spark, sf_dir):
    return _raw_base(spark, sf_dir).select("transaction_id", *CATEGORICAL_COLS)


_BASE_OUT = ["amount", "hour", "day_of_week", "is_weekend", "is_night_transaction",
             "is_international", "card_present"] + CATEGORICAL_COLS


@query("base_features", _raw_sql(
    f"SELECT transaction_id, round(amount_log, 6) AS amount_log, {', '.join(_BASE_OUT)} FROM base"))
def q_base_features(spark, sf_dir):
    return _raw_base(spark, sf_dir).select(
        "transaction_id", F.round("amount_log", 6).alias("amount_log"), *_BASE_OUT)


# ---------------------------------------------------------------------------
# Fitted encoder / scaler.  Fit set: normal (is_fraud = 0) traffic, so the
# fraud-only device label "unknown" is unseen at fit time and codes -1.
# ---------------------------------------------------------------------------
_TYPED_BASE = _base_sql("transactions", False)
_FIT_BASE = _base_sql("(SELECT * FROM transactions WHERE is_fraud = 0)", False) \
    .replace("base0 AS", "fit0 AS").replace("FROM base0)", "FROM fit0)") \
    .replace("base AS (", "fitbase AS (")
_LABELS_SQL = """
labels AS (
SELECT col, label, CAST(row_number() OVER (PARTITION BY col ORDER BY label) - 1 AS INT) AS code
FROM (SELECT DISTINCT col, label FROM (
  """ + "\n  UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS label FROM fitbase"
                              for c in CATEGORICAL_COLS) + ") u) d)"
_STATS_SQL = "stats AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in SCALED_COLS) + " FROM fitbase)"


def _encoded_sql() -> str:
    joins = "\n".join(
        f"LEFT JOIN labels l_{c} ON l_{c}.col = '{c}' AND l_{c}.label = b.{c}"
        for c in CATEGORICAL_COLS)
    cols = [f"CAST(coalesce(l_{c}.code, -1) AS DOUBLE) AS {c}" for c in CATEGORICAL_COLS]
    cols += [f"(b.{c} - s.{c}_mean) / CASE WHEN s.{c}_std = 0 THEN 1 ELSE s.{c}_std END AS {c}"
             for c in SCALED_COLS]
    cols += [f"CAST(b.{c} AS DOUBLE) AS {c}" for c in
             ("is_weekend", "is_night_transaction", "is_international", "card_present")]
    return f"""
encoded AS (
SELECT b.transaction_id, {', '.join(cols)}
FROM base b CROSS JOIN stats s
{joins})"""


def _fit_model(spark, sf_dir):
    t = transactions(spark, sf_dir)
    return ops.FeatureEncoder().fit(t.filter(F.col("is_fraud") == 0)), t


@query("encoder_fit", with_views("SELECT col AS column, label, code FROM labels",
                                 _FIT_BASE, _LABELS_SQL))
def q_encoder_fit(spark, sf_dir):
    base = ops.base_features(transactions(spark, sf_dir).filter(F.col("is_fraud") == 0))
    return ops.label_table(base).select("column", "label", F.col("code").cast("int").alias("code"))


@query("encoder_transform", with_views(
    f"SELECT transaction_id, {', '.join(f'CAST({c} AS INT) AS {c}' for c in CATEGORICAL_COLS)} "
    "FROM encoded", _TYPED_BASE, _FIT_BASE, _LABELS_SQL, _STATS_SQL, _encoded_sql()))
def q_encoder_transform(spark, sf_dir):
    model, t = _fit_model(spark, sf_dir)
    return model.feature_columns(t).select(
        "transaction_id", *[F.col(c).cast("int").alias(c) for c in CATEGORICAL_COLS])


@query("scaler_fit", with_views(
    "SELECT " + ", ".join(f"round({c}_mean, 6) AS {c}_mean, round({c}_std, 6) AS {c}_std"
                          for c in SCALED_COLS) + " FROM stats", _FIT_BASE, _STATS_SQL))
def q_scaler_fit(spark, sf_dir):
    base = ops.base_features(transactions(spark, sf_dir).filter(F.col("is_fraud") == 0))
    st = ops.scaler_stats(base)
    return st.select(*[F.round(c, 6).alias(c) for c in st.columns])


@query("scaler_transform", with_views(
    "SELECT transaction_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCALED_COLS)
    + " FROM encoded", _TYPED_BASE, _FIT_BASE, _LABELS_SQL, _STATS_SQL, _encoded_sql()))
def q_scaler_transform(spark, sf_dir):
    model, t = _fit_model(spark, sf_dir)
    return model.feature_columns(t).select(
        "transaction_id", *[F.round(c, 6).alias(c) for c in SCALED_COLS])


_MATRIX_SQL = ("SELECT transaction_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_COLUMNS)
               + " FROM encoded")


@query("feature_matrix", with_views(_MATRIX_SQL, _TYPED_BASE, _FIT_BASE, _LABELS_SQL,
                                    _STATS_SQL, _encoded_sql()))
def q_feature_matrix(spark, sf_dir):
    model, t = _fit_model(spark, sf_dir)
    return model.feature_columns(t).select(
        "transaction_id", *[F.round(c, 6).alias(c) for c in FEATURE_COLUMNS])


_FIT_ALL = _FIT_BASE.replace("(SELECT * FROM transactions WHERE is_fraud = 0)", "transactions")


@query("fit_transform", with_views(_MATRIX_SQL, _TYPED_BASE, _FIT_ALL, _LABELS_SQL,
                                   _STATS_SQL, _encoded_sql()))
def q_fit_transform(spark, sf_dir):
    t = transactions(spark, sf_dir)
    out = ops.FeatureEncoder().fit(t).transform(t)
    return out.select("transaction_id", *[F.round(c, 6).alias(c) for c in FEATURE_COLUMNS])
