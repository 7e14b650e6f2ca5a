"""Rule-based explanations (X1-X6, X8, X9) as column expressions.

Each rule gives a ``STRUCT<feature, contribution, direction>`` or null.
``top_reasons`` keeps the non-null ones, orders them by contribution
(descending, rule order on ties — a stable sort) and keeps the first three.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txsentry.functions.features import NIGHT_END_HOUR, NIGHT_START_HOUR

# Reason outputs (feature, contribution, direction) and the
# amount thresholds of the service's explanation rules.
UP, DOWN = "increases_risk", "decreases_risk"
REASONS = {
    "amount_large": ("high_amount", 0.5, UP),          # amount > 10000
    "amount_medium": ("high_amount", 0.25, UP),        # amount > 5000
    "night": ("night_transaction", 0.3, UP),           # hour >= 22 or hour <= 5
    "day": ("daytime_transaction", 0.1, DOWN),
    "international": ("international_transaction", 0.2, UP),
    "domestic": ("domestic_transaction", 0.1, DOWN),
    "card_absent": ("card_not_present", 0.15, UP),
    "unknown_device": ("unusual_device", 0.1, UP),
}
HIGH_AMOUNT_LARGE = 10000.0
HIGH_AMOUNT_MEDIUM = 5000.0
TOP_K = 3
# Fixed values of the result display: percent bands (> 40 high, > 20 medium)
# and probability bands (> 0.7 high, > 0.3 medium).
PERCENT_BANDS = (40, 20)
PROBABILITY_BANDS = (0.7, 0.3)


def _reason(name: str) -> Column:
    feature, contribution, direction = REASONS[name]
    return F.struct(F.lit(feature).alias("feature"),
                    F.lit(contribution).cast("double").alias("contribution"),
                    F.lit(direction).alias("direction"))


def reason_amount(amount: Column) -> Column:
    a = F.coalesce(amount, F.lit(0.0))
    return (F.when(a > HIGH_AMOUNT_LARGE, _reason("amount_large"))
            .when(a > HIGH_AMOUNT_MEDIUM, _reason("amount_medium")))


def reason_time(ts: Column) -> Column:
    """Night (22:00-05:59 UTC) raises, daytime lowers; no reason without a time."""
    h = F.hour(ts)
    return (F.when(h.isNull(), F.lit(None))
            .when((h >= NIGHT_START_HOUR) | (h < NIGHT_END_HOUR), _reason("night"))
            .otherwise(_reason("day")))


def reason_geo(is_international: Column) -> Column:
    return F.when(F.coalesce(is_international, F.lit(False)), _reason("international")) \
            .otherwise(_reason("domestic"))


def reason_card(card_present: Column) -> Column:
    return F.when(~F.coalesce(card_present, F.lit(True)), _reason("card_absent"))


def reason_device(device_type: Column) -> Column:
    d = F.lower(F.coalesce(device_type, F.lit("unknown")))
    return F.when(d == "unknown", _reason("unknown_device"))


def all_reasons(amount="amount", ts="timestamp", intl="is_international",
                card="card_present", device="device_type") -> list[Column]:
    c = F.col
    return [reason_amount(c(amount)), reason_time(c(ts)), reason_geo(c(intl)),
            reason_card(c(card)), reason_device(c(device))]


def top_reasons(rules: list[Column], k: int = TOP_K) -> Column:
    """ARRAY<STRUCT<feature, contribution, direction>> of at most ``k``."""
    keyed = F.array(*[F.when(r.isNotNull(), F.struct(
        (-r["contribution"]).alias("neg"), F.lit(i).alias("rule"), r.alias("r")))
        for i, r in enumerate(rules)])
    ordered = F.array_sort(F.array_compact(keyed))
    return F.transform(F.slice(ordered, 1, k), lambda x: x["r"])


def risk_sum(rules: list[Column]) -> Column:
    """Sum of the contributions that raise the risk, at most 1."""
    raised = [F.when(r["direction"] == UP, r["contribution"]).otherwise(0.0) for r in rules]
    return F.least(F.lit(1.0), sum((F.coalesce(x, F.lit(0.0)) for x in raised[1:]), F.coalesce(raised[0], F.lit(0.0))))


def display_label(feature: Column) -> Column:
    """``card_not_present`` -> ``Card Not Present``."""
    return F.initcap(F.regexp_replace(feature, "_", " "))


def percent(contribution: Column) -> Column:
    return F.round(contribution * 100).cast("int")


def percent_band(pct: Column) -> Column:
    hi, mid = PERCENT_BANDS
    return F.when(pct > hi, "high").when(pct > mid, "medium").otherwise("low")


def probability_band(p: Column) -> Column:
    hi, mid = PROBABILITY_BANDS
    return F.when(p > hi, "high").when(p > mid, "medium").otherwise("low")
