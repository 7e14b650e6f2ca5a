"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension this small broadcasts as a few MB at most.
MAX_BROADCAST_ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where null equals null; the keys of ``left`` stay."""
    names = {k: f"_right_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def broadcast_if_small(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``dim`` hinted for broadcast when it has at most ``max_rows`` rows,
    else returned as is (sort-merge join, or AQE's run-time choice).  The
    check reads at most ``max_rows + 1`` rows of the dimension, never the
    fact table."""
    small = dim.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(dim) if small else dim
