"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``share`` times all words by weight; a target stops at ``limit`` times its
source's size and the excess is reshared by weight until none is above.  A
document of a source with target t and size s is taken t/s times on average:
``floor(t/s)`` whole copies and a fractional one.

The fractions are rounded together.  Two fractional documents exchange words,
in a random direction that keeps both expectations, until one of them is
integral; sums of size x copies do not change.  Every (source, chunk) of the
corpus is one pass, from the largest document to the smallest, that ends with
at most one fractional document; these residuals are combined by the same pass
over ever fewer chunks (a reduction tree), and the last one of a source is
rounded by a draw.  A source's words therefore miss its target by less than the
size of that last document: a large one that is still open is settled by the
smaller ones that follow, if these are enough.

All draws are hashes of seed and id, so reruns agree.

Defined cases: null text or text without words has size 0 and takes 0 words;
null ids are told apart by their place in the table; rows repeated with one
id are rounded as separate documents; empty tables give empty results; input
columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from txsentry.llm.common import col, fresh, positions, shuffle_parts, written

WEIGHTS = (5, 2, 1)
CHUNK_ROWS = 8192     # documents of one pass, about
FAN_IN = 512          # chunks whose residuals meet in one pass of the next level
SMALL_SOURCES = 100_000
FREQUENT = 2000       # ids with this share of all rows are dealt to many chunks


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Resharing until no source is above its limit caps the sources in the order
    of cap / weight: one is capped if, with all before it capped, an equal
    share by weight of what is left would still exceed its cap.  Sorted once,
    with prefix sums over tasks and within them, this needs no rounds.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(sums, [F.col("source").isNull(), F.col("source")], None, "rank", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    order = ["ratio", "rank"]
    table = written(ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * limit)
                    .withColumn("ratio", F.col("cap") / F.col("w"))
                    .repartitionByRange(shuffle_parts(spark), *order).withColumn("part", F.spark_partition_id()), "targets")
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy(F.col("part").alias("p")).agg(F.sum("cap").alias("c"), F.sum("w").alias("v"))
    parts = parts.select("p", *[F.coalesce(F.sum(x).over(earlier), F.lit(0.0)).alias(x + "0") for x in ("c", "v")])   # one row a task
    total = table.agg(F.sum("source_size"), F.sum("w")).first()
    goal, all_w = (total[0] or 0) * share, total[1] or 0.0
    caps = F.col("c0") + F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.lit(all_w) - F.col("v0") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    placed = (table.join(F.broadcast(parts), F.col("part") == F.col("p"))
              .withColumn("capped", F.col("ratio") * left <= F.lit(goal) - caps))
    placed = written(placed.select("source", "source_size", "w", "cap", "capped"), "capped")
    r = placed.agg(F.sum(F.when(F.col("capped"), F.col("cap"))), F.sum(F.when(~F.col("capped"), F.col("w")))).first()
    level = (goal - (r[0] or 0.0)) / r[1] if r[1] else 0.0      # words per unit of weight
    return placed.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("w") * level)).alias("target"))


def _uniform(seed: int, *parts: int) -> float:
    text = ",".join(map(str, (seed, *parts)))
    return (xxhash.xxh64_intdigest(text) + 0.5) / 2.0 ** 64


def _transfer(x: float, a: int, y: float, b: int, u: float) -> tuple[float, float]:
    """One pivotal step of fractions x, y of documents of a and b words."""
    up, down = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)
    if u * (up + down) < down:      # words go to the first document
        return (1.0, max(0.0, y - up / b)) if (1 - x) * a <= y * b else (x + up / a, 0.0)
    return (0.0, min(1.0, y + down / b)) if x * a <= (1 - y) * b else (x - down / a, 1.0)


def _one_pass(seed: int, level: int):
    """Round the fractions of each (chunk, source) of a sorted partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None          # held: [row dict] whose fraction is open
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["chunk"], r["source"]) != group:
                    if held:
                        out.append(held)
                    group, held = (r["chunk"], r["source"]), None
                x = r["open"]
                if x is not None and r["size"] == 0:
                    r["copies"] += _uniform(seed, level, r["key"]) < x
                    r["open"] = None
                elif x is not None and 0 < x < 1:
                    if held is None:
                        held = r
                        continue
                    p, q = _transfer(held["open"], held["size"], x, r["size"], _uniform(seed, level, held["key"], r["key"]))
                    for d, v in ((held, p), (r, q)):
                        d["open"] = v if 0 < v < 1 else None
                        d["copies"] += v >= 1
                    both, held = (held, r), None
                    for d in both:
                        if d["open"] is None:
                            out.append(d)
                        else:
                            held = d
                    continue
                else:
                    r["copies"] += int(x or 0)
                    r["open"] = None
                out.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
        if held:
            yield pa.RecordBatch.from_pylist([held], schema=batch.schema)

    return run


def _frequent(rows: DataFrame, chunk_rows: int) -> list[int]:
    """Ids with more than ``chunk_rows`` rows, of those with at least 1/``FREQUENT`` of all rows."""
    found = rows.stat.freqItems(["id"], 1 / FREQUENT).first()[0]      # at most FREQUENT candidates
    found = [x for x in found if x is not None]
    counts = rows.filter(F.col("id").isin(found)).groupBy("id").agg(F.count("*").alias("n"))
    return sorted(r.id for r in counts.filter(F.col("n") > chunk_rows).collect())


def copies(rows: DataFrame, seed: int = 4, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, **shares) -> DataFrame:
    """(row, id, size, source_size, target, copies) for rows of (row, id,
    source, size); ``row`` must be unique."""
    spark = rows.sparkSession
    targets = source_targets(rows.select("source", "size"), **shares)
    n, n_sources = rows.count(), targets.count()
    chunks = max(1, -(-n // chunk_rows))
    if n_sources <= SMALL_SOURCES:
        targets = F.broadcast(targets)
    # Rows without an id, and those of an id that fills many chunks, go by their place.
    apart = F.col("id").isNull()
    if chunks > 1 and (many := _frequent(rows, chunk_rows)):
        apart = apart | F.col("id").isin(many)
    key = F.xxhash64(F.lit(seed), F.col("id"), F.when(apart, F.xxhash64("row")).otherwise(F.lit(0)))
    s = targets.withColumnRenamed("source", "src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    open_rows = (rows.join(s, F.col("source").eqNullSafe(F.col("src")))
                 .withColumn("rate", rate)
                 .select("row", "id", "source", "size", "source_size", "target",
                         F.floor("rate").cast("long").alias("copies"),
                         (F.col("rate") - F.floor("rate")).alias("open"),
                         key.alias("key"), F.pmod(key, F.lit(chunks)).alias("chunk")))
    done, level = None, 0
    while True:
        parts = min(shuffle_parts(spark), chunks)
        dealt = (open_rows.repartition(parts, "chunk")
                 .sortWithinPartitions("chunk", "source", F.desc("size"), "key", "row"))
        out = written(dealt.mapInArrow(_one_pass(seed, level), dealt.schema), f"mix-{level}")
        settled = out.filter("open IS NULL")
        done = settled if done is None else done.unionByName(settled)
        open_rows = out.filter("open IS NOT NULL")
        if chunks == 1:
            break
        chunks, level = -(-chunks // fan_in), level + 1
        open_rows = open_rows.withColumn("chunk", F.floor(F.col("chunk") / fan_in))
    # One open document per source is left: rounded by its own draw.
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), F.col("key")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    last = open_rows.withColumn("copies", F.col("copies") + (draw < F.col("open")).cast("long"))
    return done.unionByName(last).select("row", "id", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every document."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("id"),
                               col(source_col).cast("string").alias("source"), word_count(col(text_col)).alias("size")), "mix-rows")
    return copies(rows, **options).select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                                          (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          row: list[str] | None = None, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken.

    ``row``: columns that tell the rows apart and are the same at every read
    of ``docs``; without them the rows are written with numbers.
    """
    at_row, n = fresh(docs, "_row", "_copies")
    held = docs.withColumn(at_row, F.struct(*[col(c) for c in row]) if row else F.monotonically_increasing_id())
    if not row:
        held = written(held, "mix-docs")
    rows = written(held.select(F.col(at_row).alias("row"), col(id_col).cast("long").alias("id"),
                               col(source_col).cast("string").alias("source"), word_count(col(text_col)).alias("size")), "mix-rows")
    taken = copies(rows, **options).filter("copies > 0").select(F.col("row").alias(at_row + "2"), F.col("copies").alias(n))
    return (held.join(taken, F.col(at_row) == F.col(at_row + "2"))
            .withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
            .select(*[col(c) for c in docs.columns]))
