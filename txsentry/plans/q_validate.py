"""Registered validation queries (V1-V9) over the raw request feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from txsentry.functions import validate as V
from txsentry.operators import validate as ops
from txsentry.plans.catalog import query
from txsentry.plans.oracle import with_views
from txsentry.schema import REQUIRED_FIELDS
from txsentry.sources.tables import raw_transactions

_ENUM_SQL = {
    "transaction_type": "'purchase','withdrawal','transfer','refund','payment'",
    "merchant_category": ("'retail','electronics','grocery','travel','dining','healthcare',"
                          "'entertainment','online','atm','other'"),
    "device_type": "'mobile','desktop','tablet','atm','pos_terminal','unknown'",
    "channel": "'online','in_store','mobile_app','atm','call_center'",
}
_BOOL_TEXT = "'true','t','1','yes','y','on','false','f','0','no','n','off'"
_TRUE_TEXT = "'true','t','1','yes','y','on'"

_MISSING_SQL = [f"CASE WHEN {f} IS NULL THEN 'missing:{f}' END" for f in REQUIRED_FIELDS]
_AMOUNT_SQL = [
    "CASE WHEN amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount:not_a_number' END",
    "CASE WHEN TRY_CAST(amount AS DOUBLE) <= 0 THEN 'amount:not_positive' END"]
_ENUM_RULES_SQL = [f"CASE WHEN {f} IS NOT NULL AND {f} NOT IN ({v}) THEN 'invalid:{f}' END"
                   for f, v in _ENUM_SQL.items()]
_COUNTRY_SQL = ["CASE WHEN country IS NOT NULL AND NOT regexp_matches(country, '^[a-zA-Z]{2}$') "
                "THEN 'invalid:country' END"]
_TS_SQL = ["CASE WHEN timestamp IS NOT NULL AND TRY_CAST(timestamp AS TIMESTAMP) IS NULL "
           "THEN 'invalid:timestamp' END"]
_BOOL_SQL = [f"CASE WHEN {f} IS NOT NULL AND lower(trim({f})) NOT IN ({_BOOL_TEXT}) "
             f"THEN 'invalid:{f}' END" for f in ("is_international", "card_present")]
_ALL_SQL = _MISSING_SQL + _AMOUNT_SQL + _ENUM_RULES_SQL + _COUNTRY_SQL + _TS_SQL + _BOOL_SQL


def _errors_sql(rules: list[str]) -> str:
    return f"""
SELECT transaction_id, error FROM (
  SELECT transaction_id, unnest([{', '.join(rules)}]) AS error FROM raw_transactions) x
WHERE error IS NOT NULL"""


def _rule_rows(df, rules):
    return df.select("transaction_id",
                     F.explode(V.error_tags(rules)).alias("error"))


@query("required_fields", with_views(_errors_sql(_MISSING_SQL), views=("raw_transactions",)))
def q_required_fields(spark, sf_dir):
    return _rule_rows(raw_transactions(spark, sf_dir), [V.missing(f) for f in REQUIRED_FIELDS])


@query("amount_positive", with_views(_errors_sql(_AMOUNT_SQL), views=("raw_transactions",)))
def q_amount_positive(spark, sf_dir):
    return _rule_rows(raw_transactions(spark, sf_dir), V.amount_rules("string"))


@query("enum_domain", with_views(_errors_sql(_ENUM_RULES_SQL), views=("raw_transactions",)))
def q_enum_domain(spark, sf_dir):
    return _rule_rows(raw_transactions(spark, sf_dir), [V.enum_rule(f) for f in V.ENUMS])


@query("country_pattern", with_views(_errors_sql(_COUNTRY_SQL), views=("raw_transactions",)))
def q_country_pattern(spark, sf_dir):
    return _rule_rows(raw_transactions(spark, sf_dir), [V.country_rule()])


@query("defaults", with_views(f"""
SELECT transaction_id, coalesce(device_type, 'unknown') AS device_type,
  CAST(coalesce(CASE WHEN lower(trim(is_international)) IN ({_TRUE_TEXT}) THEN true
                     WHEN lower(trim(is_international)) IN ({_BOOL_TEXT}) THEN false END, false) AS INT)
    AS is_international,
  CAST(coalesce(CASE WHEN lower(trim(card_present)) IN ({_TRUE_TEXT}) THEN true
                     WHEN lower(trim(card_present)) IN ({_BOOL_TEXT}) THEN false END, true) AS INT)
    AS card_present,
  strftime(coalesce(TRY_CAST(timestamp AS TIMESTAMP), TIMESTAMP '2026-03-21 12:00:00'),
           '%Y-%m-%d %H:%M:%S') AS timestamp
FROM raw_transactions""", views=("raw_transactions",)))
def q_defaults(spark, sf_dir):
    n = ops.normalize(raw_transactions(spark, sf_dir), default_ts="2026-03-21 12:00:00")
    return n.select("transaction_id", "device_type",
                    F.col("is_international").cast("int").alias("is_international"),
                    F.col("card_present").cast("int").alias("card_present"),
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


@query("country_upper", with_views("""
SELECT transaction_id, upper(country) AS country FROM raw_transactions""",
                                   views=("raw_transactions",)))
def q_country_upper(spark, sf_dir):
    return ops.normalize(raw_transactions(spark, sf_dir)).select("transaction_id", "country")


@query("amount_round", with_views("""
SELECT transaction_id, round(TRY_CAST(amount AS DOUBLE), 2) AS amount FROM raw_transactions""",
                                  views=("raw_transactions",)))
def q_amount_round(spark, sf_dir):
    return ops.normalize(raw_transactions(spark, sf_dir)).select("transaction_id", "amount")


_REJECT_SQL = with_views(f"""
SELECT r.transaction_id, CAST(coalesce(e.n, 0) = 0 AS INT) AS accepted,
       CAST(coalesce(e.n, 0) AS INT) AS n_errors
FROM raw_transactions r LEFT JOIN (
  SELECT transaction_id, count(*) AS n FROM ({_errors_sql(_ALL_SQL)}) z GROUP BY transaction_id
) e ON e.transaction_id = r.transaction_id""", views=("raw_transactions",))


@query("reject_split", _REJECT_SQL)
def q_reject_split(spark, sf_dir):
    tagged = ops.validate(raw_transactions(spark, sf_dir))
    return tagged.select("transaction_id",
                         (F.size("errors") == 0).cast("int").alias("accepted"),
                         F.size("errors").alias("n_errors"))


@query("reject_summary", with_views(f"""
SELECT error, count(*) AS n FROM ({_errors_sql(_ALL_SQL)}) z GROUP BY error""",
                                    views=("raw_transactions",)))
def q_reject_summary(spark, sf_dir):
    return ops.reject_summary(raw_transactions(spark, sf_dir))
