"""Exact top-k search by tiled matrix products.

Components become ``floor(64 x)`` (x as double) and the score is the integer
inner product.  Queries are taken in slabs of about ``SLAB`` vectors, the only
data that is broadcast; every partition of the vectors multiplies its tiles
with the slab, keeps each query's best k + 1 of the tile, merges them into its
running list, and the lists of the partitions are merged by a tree.  Products
use doubles where every sum is exact in them and 64-bit integers otherwise.

Ties go to the smaller id (a null id after all others), then to the earlier
row.  A query's own row is no candidate; another row with the same id is.

Defined cases: a null vector, or one that holds a null or non-finite
component, takes no part; vectors of different lengths are compared as if
padded with zeros; rows with a null id are candidates but no queries; fewer
candidates than k give fewer rows; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from txsentry.llm.common import col, written

SLAB = 16_384       # queries of one broadcast
TILE = 4096         # vectors of one product
QUERY_TILE = 512
FAN_IN = 8
_LAST = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, row, v): the vectors that take part, as integer components."""
    v = col(vec_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.filter(v.isNotNull() & F.coalesce(whole, F.lit(False)))
            .select(col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * 64)).alias("v")))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``lists`` as int64, padded with zeros to ``dim``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _best(score, ids, rows, k):
    """Per line the k best entries by (score down, id up, row up)."""
    order = np.lexsort((rows, ids, -score), axis=-1)[:, :k]
    return tuple(np.take_along_axis(a, order, 1) for a in (score, ids, rows))


def _partition_lists(slab, dim: int, peak: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_rows, q = slab.value
        # Exact in doubles, in longs, or in Python's integers; a score beyond a long is an error.
        kind = np.float64 if dim * peak * peak < 1 << 53 else np.int64 if dim * peak * peak < 1 << 63 else object
        q = q.astype(kind)
        held: list = [None] * (-(-len(q) // QUERY_TILE))
        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            rows = batch.column(1).to_numpy(zero_copy_only=False)
            m = _matrix(batch.column(2), dim)
            order = np.lexsort((rows, ids))
            for a in range(0, len(order), TILE):
                at = order[a:a + TILE]
                c, i, r = m[at].astype(kind), ids[at], rows[at]
                for t, b in enumerate(range(0, len(q), QUERY_TILE)):
                    s = q[b:b + QUERY_TILE] @ c.T
                    if kind is object:      # a row with itself is no result, so its product may be any size
                        s[q_rows[b:b + QUERY_TILE, None] == r[None, :]] = 0
                    s = s.astype(np.int64)
                    n = min(k, len(at))
                    if n < len(at):
                        # The tile is sorted by id: of equal scores at the cut
                        # the first ones are taken.
                        cut = np.partition(s, len(at) - n, axis=1)[:, len(at) - n, None]
                        above = s > cut
                        room = n - above.sum(axis=1, keepdims=True)
                        equal = s == cut
                        take = above | (equal & (np.cumsum(equal, axis=1) <= room))
                        where = np.nonzero(take)[1].reshape(len(s), n)
                    else:
                        where = np.broadcast_to(np.arange(n), (len(s), n))
                    new = (np.take_along_axis(s, where, 1), i[where], r[where])
                    held[t] = _best(*(np.concatenate(x, axis=1) for x in zip(held[t], new)), k) if held[t] else new
        part = TaskContext.get().partitionId()
        for t, found in enumerate(held):
            if found is None:
                continue
            s, i, r = found
            n = s.shape[1]
            at = slice(t * QUERY_TILE, t * QUERY_TILE + len(s))
            i = i.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids[at], n)), pa.array(np.repeat(q_rows[at], n)), pa.array(i, mask=i == _LAST),
                 pa.array(r.ravel()), pa.array(s.ravel()), pa.array(np.full(s.size, part, np.int64))],
                names=["query_id", "query_row", "vec_id", "row", "score", "part"])

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          slab: int = SLAB) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    vecs = written(quantised(vectors, id_col, vec_col), "vectors")
    is_query = F.col("id") % every == 0
    n, dim, peak = vecs.agg(F.count(F.when(is_query, 1)), F.max(F.size("v")),
                            F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    dim, peak = dim or 0, peak or 0
    slabs = max(1, -(-n // slab))
    schema = "query_id long, query_row long, vec_id long, row long, score long, part long"
    out = None
    for at in range(slabs):
        mine = vecs.filter(is_query & (F.pmod(F.xxhash64("id", "row"), F.lit(slabs)) == at)).toArrow()
        q = spark.sparkContext.broadcast((mine.column("id").to_numpy(), mine.column("row").to_numpy(),
                                          _matrix(mine.column("v"), dim)))
        lists = written(vecs.mapInArrow(_partition_lists(q, dim, peak, k + 1), schema), "top-lists")
        parts = (lists.agg(F.max("part")).first()[0] or 0) + 1
        order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
        while parts > 1:
            parts = -(-parts // FAN_IN)
            lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN))
            lists = (lists.withColumn("n", F.row_number().over(Window.partitionBy("query_row", "part").orderBy(*order)))
                     .filter(F.col("n") <= k + 1).drop("n"))
        top = (lists.filter("row != query_row")
               .withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order)))
               .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        out = top if out is None else out.unionByName(top)
    return out


SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
