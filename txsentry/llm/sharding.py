"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards.  A shard draws
``ln(u) / weight`` with ``u`` a uniform hash of (key, shard); the draw of a rack
is the largest of its shards' draws and that of a region the largest of its
racks'.  A row descends from the root to the child with the largest draw at
every level.  The least of exponential variables has the sum of their rates,
so a node wins with the share of its summed weight; and as a changed weight
changes the draws of one shard and of the nodes above it only, rows move into
a subtree that grew or out of one that shrank, and all others keep their
places, whatever the number of shards.

``balanced_tree(n)`` lays the first eight shards out as 2 regions x 2 racks x
2 shards; every further shard opens a region of its own.  One more shard takes
rows only into itself (law ``key``) at every n.

Defined cases: the key alone decides, a null key is one more key value; a
null text has size 1 (no bytes plus 1) and the CRC of an empty text; rows
repeated with one id share a shard and get different slots; input columns
named like an output column are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from txsentry.llm.common import col, positions, without


class Shard(NamedTuple):
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def balanced_tree(n: int) -> list[Shard]:
    """``n`` shards of weight 1 in the layout described above."""
    if n < 1:
        raise ValueError("a tree needs at least one shard")
    return [Shard(s, f"g{s // 4}", f"g{s // 4}/k{s // 2}") if s < 8 else Shard(s, f"x{s}", f"x{s}/k")
            for s in range(n)]


def _name(s: Shard) -> str:
    return f"{s.rack}/s{s.shard}"


def _draw(key: Column, node: str, weight: float) -> Column:
    # 52 bits of MD5 as a uniform in (0, 1); ln(u)/weight is the weighted draw.
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + node))), 1, 13), 16, 10).cast("double")
    return F.log((bits + 0.5) / float(1 << 52)) / weight


def _largest(draws: list[Column]) -> Column:
    return F.greatest(*draws) if len(draws) > 1 else draws[0]


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """Shard number by descending the levels region, rack and shard (ties:
    the later name).  Winners are passed up with their draws, so every shard
    draws once."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in live:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)

    def shard(s: Shard) -> Column:
        name = _name(s)
        return F.struct(_draw(key, name, s.weight).alias("d"), F.lit(name).alias("n"), F.lit(s.shard).alias("v"))

    return _largest([_largest([_largest([shard(s) for s in rack]) for rack in racks.values()]) for racks in regions.values()])["v"]


OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """Every row with its size, CRC, shard, gapless slot within the shard (in
    id order) and the shard it would have with one more.  ``keep``: columns to
    carry (all by default)."""
    rows = docs.select(*([col(c) for c in keep] if keep is not None else without(docs, *OUT)),
                       (F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
                       F.lit("key").alias("law"),
                       shard_of(col(id_col), balanced_tree(shards)).alias("shard"),
                       shard_of(col(id_col), balanced_tree(shards + 1)).alias("grown_shard"))
    return positions(rows, [F.col("shard"), col(id_col), F.col("text_crc32"), F.col("size")], "shard", "slot", "slots")


def _sql_pick(shards: int) -> str:
    draws = [f"{{'d': ln((('0x' || substr(md5(k || '|{_name(s)}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {s.weight}, 'v': {s.shard}}}"
             for s in balanced_tree(shards)]
    return f"greatest({', '.join(draws)}).v"


# CRC-32 by bytes, its table from the polynomial; the shard with the largest draw of all.
SQL = f"""
WITH crc_table AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c
  FROM range(256) r(n))),
b AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, length(h) // 2 + 1 AS size,
             [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)] AS bytes
      FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
s AS (SELECT doc_id, size, CAST({_sql_pick(8)} AS INT) AS shard, CAST({_sql_pick(9)} AS INT) AS grown_shard,
             xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
      FROM b, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM s
"""
