"""Connected components of an edge table by alternating star contractions.

Each round is a fixed number of equi-joins and partial aggregates; no node's
neighbours are ever gathered in one row, and each round's edges are written
to the shared folder.  Hubs, the nodes with at least 1/``HUBS`` of all edge
ends (so at most ``HUBS`` of them), meet their edges by broadcast, all others
by a shuffle in which no node has more than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txsentry.llm.common import written


HUBS = 1000


def _with_low(edges: DataFrame, low: DataFrame, ends: int) -> DataFrame:
    """``edges`` with ``m`` of ``low`` (u, m, n) for their u."""
    hub = F.col("n") * HUBS >= ends
    met = edges.join(F.broadcast(low.filter(hub).select("u", "m")), "u", "left")
    rest = met.filter("m IS NULL").drop("m").join(low.filter(~hub).select("u", "m"), "u")
    return met.filter("m IS NOT NULL").unionByName(rest)


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_low(both.filter("v > u"), low, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    star = _with_low(down, low, n)
    return (star.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every
    node of an edge between two different nodes."""
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct(), "edges")
    before, n = None, e.count()
    while True:
        # A star's edges are at most as many as those that it is made of.
        large = written(_large_star(e, n).distinct(), "edges")
        e = written(_small_star(large, n).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, max(1, now[0])
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
