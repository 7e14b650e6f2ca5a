"""Batch/stream request validation.

``validate`` tags every row with its violated rules; ``split`` routes rows
with no violation to the normalised accepted table and the rest, with their
reasons, to a quarantine table.  Both are narrow (no shuffle) and work on a
streaming DataFrame unchanged.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txsentry.functions import validate as V
from txsentry.functions.features import as_double, as_timestamp
from txsentry.schema import TRANSACTION


def _types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.typeName() for f in df.schema.fields}


def with_missing_columns(df: DataFrame) -> DataFrame:
    """Absent request fields become null columns, so defaults and rules apply."""
    absent = [f for f in TRANSACTION.fieldNames() if f not in df.columns]
    return df.withColumns({f: F.lit(None).cast("string") for f in absent}) if absent else df


def validate(df: DataFrame) -> DataFrame:
    """Add ``errors ARRAY<STRING>`` (empty when the row is valid)."""
    df = with_missing_columns(df)
    return df.withColumn("errors", V.error_tags(V.request_rules(_types(df))))


def _default_ts(default_ts) -> Column:
    if default_ts is None:
        return F.current_timestamp()
    if isinstance(default_ts, (dt.datetime, str)):
        return F.lit(default_ts).cast("timestamp")
    return default_ts


def normalize(df: DataFrame, default_ts=None) -> DataFrame:
    """Typed, normalised request rows: defaults, upper-case country, amount to cents.

    ``default_ts`` replaces an absent timestamp (wall clock when None).
    """
    df = with_missing_columns(df)
    types = _types(df)
    ts = as_timestamp(F.col("timestamp"), types["timestamp"])
    return df.withColumns({
        "amount": F.round(as_double(F.col("amount"), types["amount"]), 2),
        "country": F.upper("country"),
        "device_type": F.coalesce(F.col("device_type"), F.lit("unknown")),
        "timestamp": F.coalesce(ts, _default_ts(default_ts)),
        "is_international": V.parse_bool("is_international", types["is_international"], False),
        "card_present": V.parse_bool("card_present", types["card_present"], True),
    })


def split(df: DataFrame, default_ts=None) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): accepted rows normalised to the TRANSACTION
    schema (plus any extra columns), quarantined rows keep their raw values
    and ``errors``."""
    tagged = validate(df)
    ok = F.size("errors") == 0
    accepted = normalize(tagged.filter(ok), default_ts).drop("errors")
    return accepted, tagged.filter(~ok)


def reject_summary(df: DataFrame) -> DataFrame:
    """Rows per violated rule (a row with two violations counts under both).
    One conditional-count aggregate over the rules, no explode."""
    df = with_missing_columns(df)
    counts = V.rule_counts(df, V.request_rules(_types(df)), "error")
    return counts.filter(F.col("n") > 0)


def prediction_check(pred: DataFrame) -> DataFrame:
    """Add ``errors`` for rows that break the prediction output contract."""
    return pred.withColumn("errors", V.error_tags(V.prediction_rules()))


def prediction_summary(pred: DataFrame) -> DataFrame:
    """Violations per contract rule, every rule listed (zero when clean)."""
    return V.rule_counts(pred, V.prediction_rules(), "rule")
