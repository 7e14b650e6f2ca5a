"""Request validation rules as column expressions.

A rule is a pair ``(tag, condition)``: the row violates the rule when the
condition is true.  ``error_tags`` turns a list of rules into an
``ARRAY<STRING>`` of the violated tags with ``concat`` of one-element
arrays — no higher-order function, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txsentry.functions.features import as_double, as_timestamp
from txsentry.schema import (CHANNELS, COUNTRY_PATTERN, DECISIONS, DEVICE_TYPES,
                             FALSE_TEXT, MAX_REASONS, MERCHANT_CATEGORIES,
                             REASON_DIRECTIONS, REQUIRED_FIELDS, RISK_LEVELS,
                             TRANSACTION_TYPES, TRUE_TEXT)

ENUMS = {"transaction_type": TRANSACTION_TYPES, "merchant_category": MERCHANT_CATEGORIES,
         "device_type": DEVICE_TYPES, "channel": CHANNELS}

Rule = tuple[str, Column]


def missing(field: str) -> Rule:
    return f"missing:{field}", F.col(field).isNull()


def amount_rules(type_name: str) -> list[Rule]:
    a = F.col("amount")
    num = as_double(a, type_name)
    return [("amount:not_a_number", a.isNotNull() & num.isNull()),
            ("amount:not_positive", num <= 0)]


def enum_rule(field: str) -> Rule:
    c = F.col(field)
    return f"invalid:{field}", c.isNotNull() & ~c.isin(*ENUMS[field])


def country_rule() -> Rule:
    c = F.col("country")
    return "invalid:country", c.isNotNull() & ~c.rlike(COUNTRY_PATTERN)


def timestamp_rule(type_name: str) -> Rule:
    c = F.col("timestamp")
    return "invalid:timestamp", c.isNotNull() & as_timestamp(c, type_name).isNull()


def bool_rule(field: str, type_name: str) -> Rule | None:
    if type_name != "string":
        return None
    c = F.lower(F.trim(F.col(field)))
    return f"invalid:{field}", F.col(field).isNotNull() & ~c.isin(*(TRUE_TEXT + FALSE_TEXT))


def parse_bool(field: str, type_name: str, default: bool) -> Column:
    c = F.col(field)
    if type_name == "string":
        t = F.lower(F.trim(c))
        parsed = F.when(t.isin(*TRUE_TEXT), True).when(t.isin(*FALSE_TEXT), False)
    else:
        parsed = c.cast("boolean")
    return F.coalesce(parsed, F.lit(default))


def request_rules(types: dict[str, str]) -> list[Rule]:
    """All request rules in a fixed order, given column -> type name."""
    rules = [missing(f) for f in REQUIRED_FIELDS]
    rules += amount_rules(types.get("amount", "double"))
    rules += [enum_rule(f) for f in ENUMS]
    rules.append(country_rule())
    rules.append(timestamp_rule(types.get("timestamp", "timestamp")))
    for f in ("is_international", "card_present"):
        r = bool_rule(f, types.get(f, "boolean"))
        if r is not None:
            rules.append(r)
    return rules


def error_tags(rules: list[Rule]) -> Column:
    """Violated tags of a row, in rule order (empty when valid)."""
    empty = F.array().cast("array<string>")
    parts = [F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(tag))).otherwise(empty)
             for tag, cond in rules]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def rule_counts(df, rules: list[Rule], name: str = "error"):
    """Rows per violated rule: one partial aggregate of conditional counts,
    unpivoted to (name, n); rules nobody violates are left out."""
    counts = df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(f"c{i}")
                      for i, (_, cond) in enumerate(rules)])
    pairs = ", ".join(f"'{tag}', c{i}" for i, (tag, _) in enumerate(rules))
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) AS ({name}, n)")


def prediction_rules() -> list[Rule]:
    """Output contract of a prediction row."""
    p, a = F.col("fraud_probability"), F.col("anomaly_score")
    reasons = F.col("top_reasons")
    directions = reasons["direction"]
    bad_dir = F.size(F.array_except(F.coalesce(directions, F.array().cast("array<string>")),
                                    F.array(*[F.lit(d) for d in REASON_DIRECTIONS]))) > 0
    return [
        ("fraud_probability:out_of_range", p.isNull() | (p < 0) | (p > 1)),
        ("anomaly_score:out_of_range", a.isNull() | (a < 0) | (a > 1)),
        ("risk_level:invalid", F.col("risk_level").isNull()
         | ~F.col("risk_level").isin(*RISK_LEVELS)),
        ("decision:invalid", F.col("decision").isNull() | ~F.col("decision").isin(*DECISIONS)),
        ("top_reasons:too_many", F.size(reasons) > MAX_REASONS),
        ("top_reasons:bad_direction", bad_dir),
    ]
