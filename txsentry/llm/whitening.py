"""Whitening of embeddings by blockwise QR and a bidiagonal qd solver.

Entries become integers ``floor(scale * c) + offset``; the n vectors whose
entries are all finite are both fitted and transformed.  With S the sums per
dimension, n x - S are the centred rows times n, exact integers.

Fit: every task reduces its centred rows block by block to one triangle R
(QR of the rows of a block below the triangle so far); triangles meet
``FAN_IN`` at a time until one d x d triangle is left, so no task holds more
than ``FAN_IN`` of them and nothing grows with the rows.  The covariance is
R'R / n and is never formed: R is made bidiagonal, dqds gives its singular
values and twisted factorisations its right vectors (``bidiagonal``).  What
reaches the driver is one row of sums and the directions: d and k x d numbers.

Transform: (x - S/n) along each direction over the square root of its
eigenvalue.  ``identity_error`` is measured on the whitened rows themselves:
counts, means and centred products of blocks are combined over all tasks.

Defined cases: null vectors, empty ones and those holding null or non-finite
entries take no part; vectors of another length than the most frequent one
(ties: the longer) lie in another space and take no part either; directions
without variance (singular value within ``NOISE`` x d roundings of the largest)
are not components, so a table of equal vectors gives an empty result, as an
empty table does; entries of ``2**52`` or more, scaled, and deviations beyond a
long raise an error; null and repeated ids keep one set of rows per row;
columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from txsentry.llm.bidiagonal import EPS, right_vectors
from txsentry.llm.common import col, written

SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 32
FAN_IN = 16          # triangles (or moments) that meet in one task
BLOCK_ROWS = 4096    # rows of one QR or product
NOISE = 1024.0       # singular values below NOISE * d roundings of the largest are no directions


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the non-empty vectors without null or non-finite entries, as doubles."""
    rows = df.select(col(id_col).alias("vec_id"), col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size("v") > 0) & F.coalesce(finite, F.lit(False)))


def _blocks(batch: pa.RecordBatch, scale: float, offset: int, dim: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer rows) of a batch, ``BLOCK_ROWS`` rows of one length at a time."""
    for k in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(k, BLOCK_ROWS)
        ids, vecs = part.column(0), part.column(1)
        lengths = np.diff(np.asarray(vecs.offsets))
        values = np.asarray(vecs.flatten(), np.float64)
        x = np.floor(scale * values)
        if len(x) and np.abs(x).max() >= 2.0 ** 52:
            raise OverflowError("a scaled entry is too large to be whole in a double")
        x = x.astype(np.int64) + offset
        ends = np.cumsum(lengths)
        for d in np.unique(lengths).tolist() if dim is None else [dim]:
            rows = np.flatnonzero(lengths == d)
            if len(rows):
                at = (ends[rows] - d)[:, None] + np.arange(d)
                yield ids.take(pa.array(rows)), x[at]


def sums(vectors: DataFrame, scale: float = SCALE, offset: int = OFFSET) -> tuple[int, np.ndarray] | None:
    """(n, exact sums per dimension) of the integer vectors of the most
    frequent length; None without vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for _, x in _blocks(batch, scale, offset):
                n, s = held.get(x.shape[1], (0, [0] * x.shape[1]))
                # A block's sums fit in 63 bits up to 2^50; Python integers hold the rest.
                exact = x if np.abs(x).max() < 1 << 50 else x.astype(object)
                held[x.shape[1]] = n + len(x), [a + b for a, b in zip(s, exact.sum(axis=0).tolist())]
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()),
                                              pa.array([str(v) for v in s])], names=["d", "n", "pos", "s"])

    rows = vectors.mapInArrow(run, "d int, n long, pos int, s string")
    found = (rows.groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    found = written(found, "whitening-sums")
    top = found.filter("pos = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if top is None:
        return None
    s = found.filter(F.col("d") == top.d).orderBy("pos").select(F.col("s").cast("string")).collect()   # one row per dimension
    return top.n, np.array([int(r[0]) for r in s], object)


def _centre(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n x - S as exact int64."""
    if max(abs(int(x.max())), abs(int(x.min()))) * n + int(max(abs(v) for v in s)) >= 1 << 63:
        return x.astype(object) * n - s
    return x * n - s.astype(np.int64)


def _merge(name: str, first, join, rows: DataFrame, emit) -> np.ndarray | None:
    """One array from all tasks: ``emit`` gives the blocks of a batch, ``first``
    folds them in a task, ``join`` joins two results, ``FAN_IN`` a task and level."""
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for block in emit(batch):
                held = first(held, block)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([held.tobytes()], pa.binary())], names=["part", "m"])

    def fold(table: pa.Table) -> pa.Table:
        held = None
        for part, m in sorted(zip(table.column("part").to_pylist(), table.column("m").to_pylist())):
            low = part if held is None else low
            one = np.frombuffer(m, np.float64)
            held = one if held is None else join(held, one)
        return pa.table({"part": pa.array([low // FAN_IN], pa.int64()), "m": pa.array([held.tobytes()], pa.binary())})

    schema = "part long, m binary"
    now = written(rows.mapInArrow(start, schema), f"{name}-0")
    level, n = 0, now.count()
    while n > 1:
        # The numbers of the parts shrink by FAN_IN a level.
        level += 1
        groups = now.withColumn("g", F.floor(F.col("part") / FAN_IN))
        now = written(groups.groupBy("g").applyInArrow(lambda t: fold(t.drop_columns(["g"])), schema), f"{name}-{level}")
        n = now.count()
    row = now.first()
    return None if row is None else np.frombuffer(row.m, np.float64)


def triangle(vectors: DataFrame, n: int, s: np.ndarray, scale: float = SCALE, offset: int = OFFSET) -> np.ndarray:
    """R of the QR of all centred rows."""
    d = len(s)

    def emit(batch):
        for _, x in _blocks(batch, scale, offset, d):
            yield (_centre(x, n, s) / n).astype(np.float64)

    def qr(held, block):
        both = block if held is None else np.vstack((held.reshape(-1, d), block))
        return np.ascontiguousarray(np.linalg.qr(both, mode="r"))

    return _merge("whitening-r", qr, lambda a, b: qr(a, b.reshape(-1, d)).ravel(), vectors, emit).reshape(-1, d)


def directions(r: np.ndarray, n: int, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues of the covariance, unit directions as rows, its trace)."""
    d = r.shape[1]
    full = np.vstack((r, np.zeros((max(0, d - len(r)), d))))
    values, vectors = right_vectors(full)
    values = values / n
    real = values > (NOISE * d * EPS) ** 2 * values[0] if values[0] > 0 else np.zeros(d, bool)
    keep = int(min(real.sum(), components))
    return values[:keep], vectors[:keep], float((r * r).sum() / n)


def _moments(held: np.ndarray | None, w: np.ndarray) -> np.ndarray:
    """(count, means, centred products) of a block, joined to what is held."""
    mean = w.mean(axis=0)
    c = w - mean
    return _pool(held, np.concatenate(([len(w)], mean, (c.T @ c).ravel())))


def _pool(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b
    k = int((np.sqrt(4 * len(a) - 3) - 1) / 2)       # 1 + k + k * k numbers
    n, m = a[0], b[0]
    gap = b[1:k + 1] - a[1:k + 1]
    prod = a[k + 1:] + b[k + 1:] + (np.outer(gap, gap) * (n * m / (n + m))).ravel()
    return np.concatenate(([n + m], a[1:k + 1] + gap * (m / (n + m)), prod))


SCHEMA = "vec_id {id}, component int, n long, deviation long, whitened double, explained double"


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row per remaining vector and component: (vec_id, component, n,
    deviation, whitened, explained, identity_error)."""
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vec_col)
    schema = SCHEMA.format(id=vectors.schema["vec_id"].dataType.simpleString())
    fit = sums(vectors, scale, offset)
    values = np.zeros(0)
    if fit:
        n, s = fit
        r = triangle(vectors, n, s, scale, offset)
        values, axes, trace = directions(r, n, components)
    if not len(values):
        return spark.createDataFrame([], schema + ", identity_error double")
    k, d = axes.shape
    roots, shares = np.sqrt(values), values / trace

    def blocks(batch):
        for ids, x in _blocks(batch, scale, offset, d):
            y = _centre(x, n, s)
            yield ids, y, (y / n).astype(np.float64) @ axes.T / roots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, y, w in blocks(batch):
                size = float(np.abs(y.astype(np.float64)).max())
                if size * size * d >= 2.0 ** 62:       # beyond int64 sums: exact in Python's integers
                    dev = [int(v) for v in (y.astype(object) ** 2).sum(axis=1)]
                else:
                    dev = (y.astype(np.int64) ** 2).sum(axis=1)
                m = len(w)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(np.array(dev, np.int64), k)), pa.array(w.ravel()),
                     pa.array(np.tile(shares, m))], names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    pooled = _merge("whitening-check", _moments, _pool, vectors, lambda b: (w for _, _, w in blocks(b)))
    error = float(np.abs(pooled[k + 1:].reshape(k, k) / n - np.eye(k)).max())
    return vectors.mapInArrow(run, schema).withColumn("identity_error", F.lit(error))
