"""SimHash near-dedup with pivot distance tables.

Fingerprint (contract of ``op9``): A-Z lower-cased, words between ASCII white
space, shingles of three words with repeats (fewer words: the whole
sequence), XXH64 with seed 42; a bit is 1 if set in over half the shingles;
no words: zero.

Links (at most two differing bits) are found over distinct fingerprints:

* every fingerprint gets a table of its Hamming distances to ``PIVOTS``
  reference fingerprints;
* two fingerprints within two bits agree on at least three of five bit
  blocks, so candidates share one of ten keys of 38 or 39 bits;
* a candidate pair whose distances to any pivot differ by more than two is
  discarded (triangle inequality), survivors are verified by XOR;
* a key shared by more than ``BUCKET`` fingerprints is not paired: its members
  are grouped by every fingerprint within one bit of them instead.  Two
  fingerprints within two bits share such a centre, and a centre has at most
  65 members, so these links are exact as well and linear in number.

Exact copies are one fingerprint row with a count, never pairs.

Defined cases: null or blank text has fingerprint zero and links like any
other; rows repeated with one id are all returned; a component of null ids
only has a null id, otherwise nulls are ignored in the minimum; empty tables
give empty results; clashing extra columns are not read.
"""

from __future__ import annotations

import random
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from txsentry.llm.common import col, fresh, written
from txsentry.llm.components import components

PIVOTS = 16          # reference fingerprints
MAX_BITS = 2         # the five blocks below are laid out for two bits
BUCKET = 64          # members of a key that are paired; larger keys go by centres
BLOCKS = (13, 13, 13, 13, 12)


def simhash(text: str | None, words: int = 3) -> int:
    """Unsigned fingerprint of one text."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1))
    pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1:].tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(pieces)).astype("<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = h[k:k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))

    return fp(text.cast("string"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_distances(fp: Column, pivots: int = PIVOTS) -> Column:
    """Hamming distances to the reference fingerprints."""
    rng = random.Random(9)
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(rng.getrandbits(64))).cast("long"))).cast("tinyint")
                     for _ in range(pivots)])


def _keys(fp: Column) -> Column:
    masks, at = [], 0
    for n in BLOCKS:
        masks.append(((1 << n) - 1) << at)
        at += n
    three = [reduce(int.__or__, m) for m in combinations(masks, 3)]
    return F.array(*[F.struct(F.lit(k).cast("tinyint").alias("part"),
                              fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
                     for k, m in enumerate(three)])


def _linked(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y structs of fp and d) that pass the pivot test and the XOR test."""
    far = F.exists(F.zip_with("x.d", "y.d", lambda p, q: F.abs(p.cast("int") - q.cast("int"))),
                   lambda g: g > MAX_BITS)
    return (pairs.filter(~far)
            .filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS)
            .select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")))


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints of ``nodes`` (column fp)
    whose transitive closure is that of all pairs within two bits."""
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.part", "k.key")
    counts = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keyed.join(counts, ["part", "key"])

    def paired(frame, *by):
        groups = frame.groupBy(*by).agg(F.collect_list(F.struct("fp", pivot_distances(F.col("fp")).alias("d"))).alias("m"))
        return _linked(groups.select(F.explode(F.flatten(F.transform(
            "m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("x"), y.alias("y")))
        ))).alias("p")).select("p.x", "p.y"))

    near = paired(members.filter(F.col("n") <= bucket), "part", "key")
    # Frequent keys: every member meets its neighbours at the centres within
    # one bit of it; each centre links its (at most 65) members to the smallest.
    hot = members.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)).cast("long") for k in range(64)])
    centres = hot.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("centre"))
    groups = centres.groupBy("centre").agg(F.collect_list("fp").alias("m")).filter(F.size("m") > 1)
    stars = groups.select(F.array_min("m").alias("u"), F.explode("m").alias("v")).filter("u != v").distinct()
    with_d = lambda c: F.struct(F.col(c).alias("fp"), pivot_distances(F.col(c)).alias("d"))
    return near.unionByName(_linked(stars.select(with_d("u").alias("x"), with_d("v").alias("y"))))


def _rooted(rows: DataFrame, bucket: int) -> DataFrame:
    """(fp, copies, root): every distinct fingerprint of ``rows`` (column fp)
    with the smallest fingerprint of its component."""
    nodes = written(rows.groupBy("fp").agg(F.count("*").alias("copies")), "simhash-nodes")
    comp = components(links(nodes, bucket), "u", "v").withColumnRenamed("node", "fp")
    return nodes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies): one row per document;
    ``copies`` counts the documents with the same fingerprint."""
    rows = written(docs.select(col(id_col).cast("long").alias("id"), fingerprint(col(text_col), words).alias("fp")),
                   "simhash")
    rooted = _rooted(rows, bucket)
    low = rows.groupBy("fp").agg(F.min("id").alias("low"))
    lows = rooted.join(low, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id", "copies")
    return rows.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id", "copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
             bucket: int = BUCKET, row: list[str] | None = None) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id
    (null ids last, repeated ids by their place in the table).

    ``row``: columns that tell the rows apart and are the same at every read
    of ``docs``; without them the rows are written with numbers.
    """
    at_row, fp = fresh(docs, "_row", "_fp")
    held = docs.withColumn(at_row, F.struct(*[col(c) for c in row]) if row else F.monotonically_increasing_id())
    slim = [col(id_col).alias("id"), F.col(at_row).alias("row")]
    if row:
        slim = written(held.select(*slim, fingerprint(col(text_col), words).alias("fp")), "simhash")
    else:
        held = written(held.withColumn(fp, fingerprint(col(text_col), words)), "simhash-docs")
        slim = held.select(*slim, F.col(fp).alias("fp"))
    low = slim.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("low"))
    reps = (_rooted(slim, bucket).join(low, "fp").groupBy("root").agg(F.min("low").alias("low"))
            .select(F.col("low.row").alias("_rep")))
    return held.join(reps, F.col(at_row) == F.col("_rep"), "left_semi").drop(at_row, fp)
