"""Risk blending and tiering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txsentry.schema import BANDS, DEFAULT_THRESHOLDS, RiskThresholds


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def combined_score(p, a, t: RiskThresholds = DEFAULT_THRESHOLDS) -> Column:
    """clip(alpha * p + beta * a, 0, 1)."""
    raw = F.lit(t.alpha) * _col(p) + F.lit(t.beta) * _col(a)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def risk_level(score, t: RiskThresholds = DEFAULT_THRESHOLDS) -> Column:
    """Band of the unrounded score; bounds are inclusive upper limits."""
    s, level = _col(score), F.lit(BANDS[-1].level)
    for band in reversed(BANDS[:-1]):
        level = F.when(s <= getattr(t, band.bound), band.level).otherwise(level)
    return level


def decision(level) -> Column:
    lv, out = _col(level), F.lit(None).cast("string")
    for band in BANDS:
        out = F.when(lv == band.level, band.decision).otherwise(out)
    return out


def rounded(x, digits: int = 6, then: int | None = 4) -> Column:
    """Engine result keeps 6 digits, the response 4: round(round(x, 6), 4)."""
    r = F.round(_col(x), digits)
    return F.round(r, then) if then is not None else r


def binary_decision(p, a, weight_p: float, weight_a: float, threshold: float) -> Column:
    """Legacy two-way rule: weighted score above the threshold blocks."""
    score = F.lit(weight_p) * _col(p) + F.lit(weight_a) * _col(a)
    return F.when(score > threshold, "BLOCK").otherwise("ALLOW")
