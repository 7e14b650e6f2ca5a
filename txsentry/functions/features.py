"""Stateless feature expressions.

Every function takes the input column and its Spark type name so the same
rule serves typed tables (DOUBLE, TIMESTAMP, BOOLEAN) and raw request text.
All are native expressions: they fuse into one whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txsentry.schema import TRUE_TEXT

# Night is [22:00, 06:00) UTC; weekend is day_of_week >= 5
# (0 = Monday).
NIGHT_START_HOUR = 22
NIGHT_END_HOUR = 6
WEEKEND_FIRST_DAY = 5


def as_double(c: Column, type_name: str) -> Column:
    return c.try_cast("double") if type_name == "string" else c.cast("double")


def as_timestamp(c: Column, type_name: str) -> Column:
    return c.try_cast("timestamp") if type_name == "string" else c.cast("timestamp")


def amount_clean(c: Column, type_name: str = "double") -> Column:
    """Numeric amount; unparsable or missing -> 0, negatives clipped to 0."""
    return F.greatest(F.coalesce(as_double(c, type_name), F.lit(0.0)), F.lit(0.0))


def amount_log(clean_amount: Column) -> Column:
    return F.log1p(clean_amount)


def event_hour(ts: Column) -> Column:
    """UTC hour of day; unparsable -> 0."""
    return F.coalesce(F.hour(ts), F.lit(0))


def day_of_week(ts: Column) -> Column:
    """0 = Monday ... 6 = Sunday; unparsable -> 0."""
    return F.coalesce(F.weekday(ts), F.lit(0))


def is_weekend(dow: Column) -> Column:
    return (dow >= WEEKEND_FIRST_DAY).cast("int")


def is_night(hour: Column) -> Column:
    """22:00-05:59."""
    return ((hour >= NIGHT_START_HOUR) | (hour < NIGHT_END_HOUR)).cast("int")


def bool_flag(c: Column, type_name: str) -> Column:
    """Boolean or boolean text -> 0/1; null and unknown text -> 0."""
    if type_name == "string":
        return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_TEXT).cast("int"), F.lit(0))
    if type_name == "boolean":
        return F.coalesce(c.cast("int"), F.lit(0))
    return F.coalesce((c.cast("double") != 0).cast("int"), F.lit(0))


def category_fill(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("unknown"))
