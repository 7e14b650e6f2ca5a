"""Intermediate tables in the shared work folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from txsentry.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: several consumers read it
    instead of recomputing it, its lineage is cut, and a lost executor costs a
    reread."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
