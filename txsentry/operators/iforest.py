"""Distributed isolation forest (M4-M7); Liu, Ting & Zhou (2008).

Fit: one sampling scheme at every table size.  A seeded hash of a row's id
and feature values says how many trees it enters (1.5 * psi * n_trees / n on
average, so about 1.5 * psi * n_trees entries in all, whatever the table's
size), a second one which; rows equal in id and features are counted map-side
and travel as one.  ``groupBy("tree").applyInPandas`` keeps the psi entries of
lowest priority and grows one isolation tree on them with numpy.  Null and
repeated ids are no special case.  A tree without any row is an error.  The
result is a node table of at most n_trees * (2 * psi - 1) rows.

Score: the node table is bounded by (n_trees, psi), so it is broadcast, laid
out as bit vectors (``ForestBits``); a ``pandas_udf`` finds the leaves of an
Arrow batch of rows in all trees of a chunk at once.  The raw
score is -2^(-E[h(x)] / c(psi)) (higher = more normal), so the normalised
anomaly score 1 - (raw - min) / (max - min) does not depend on the
contamination offset of other implementations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_TREES = 200
MAX_SAMPLES = 256
SEED = 42
CANDIDATE_FACTOR = 1.5

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
])


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Isolation tree as parallel lists; leaves have feature -1."""
    feature, threshold, left, right, size = [], [], [], [], []

    def new(n):
        for lst, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (size, n)):
            lst.append(v)
        return len(feature) - 1

    root = new(len(x))
    stack = [(root, np.arange(len(x)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        li, ri = idx[go_left], idx[~go_left]
        ln, rn = new(len(li)), new(len(ri))
        feature[node], threshold[node], left[node], right[node] = f, t, ln, rn
        stack.append((ln, li, depth + 1))
        stack.append((rn, ri, depth + 1))
    return feature, threshold, left, right, size


def _fit_tree_fn(feature_cols: list[str], psi: int, seed: int):
    max_depth = max(1, math.ceil(math.log2(max(psi, 2))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["_prio", *feature_cols], kind="stable")
        pdf = pdf.loc[pdf.index.repeat(pdf["_copies"].clip(upper=psi))].head(psi)
        x = pdf[feature_cols].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        f, t, lft, rgt, size = _grow(x, rng, max_depth)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(f), dtype=np.int32),
                             "feature": f, "threshold": t, "left": lft, "right": rgt,
                             "size": size})
    return fit


class ForestBits:
    """A forest as bit vectors, which finds the leaves of a batch of rows
    without walking its trees.

    The leaves of a tree are numbered from left to right.  For a feature, the
    thresholds of one tree divide its values into ranks, and every rank has the
    set of leaves that the tests on this feature leave open, as a mask of bits.
    The sets of all features have exactly one leaf in common: the one that the
    row reaches.  A batch costs, per feature, one search among the sorted
    thresholds of a chunk of trees, one lookup of the ranks of all its trees and
    one AND.  Size: at most (2 psi - 1) masks a tree, and a rank per threshold
    and tree of the same chunk.
    """

    CHUNK = 64          # trees looked up together
    ROWS = 256          # rows of one block, so that its masks stay in cache

    def __init__(self, nodes: pd.DataFrame, n_features: int):
        ordered = nodes.sort_values(["tree", "node"])
        trees = [self._tree(t) for _, t in ordered.groupby("tree", sort=True)]
        self.words = max(1, -(-max(len(t[0]) for t in trees) // 64))
        self.chunks = [self._chunk(trees[k:k + self.CHUNK], n_features) for k in range(0, len(trees), self.CHUNK)]

    @staticmethod
    def _tree(t: pd.DataFrame):
        """(path length of every leaf, {feature: [(threshold, left leaves, right leaves)]})."""
        feature, threshold, left, right, size = (t[c].tolist() for c in ("feature", "threshold", "left", "right", "size"))
        lengths: list[tuple[int, int]] = []
        span: dict[int, tuple[int, int]] = {}
        tests: dict[int, list[tuple[float, tuple[int, int], tuple[int, int]]]] = {}
        stack = [(0, 0, False)]
        while stack:                   # left to right; a node's leaves are known after both sides
            k, depth, done = stack.pop()
            if feature[k] < 0:
                span[k] = (len(lengths), len(lengths) + 1)
                lengths.append((depth, size[k]))
            elif done:
                span[k] = (span[left[k]][0], span[right[k]][1])
                tests.setdefault(feature[k], []).append((threshold[k], span[left[k]], span[right[k]]))
            else:
                stack += [(k, depth, True), (right[k], depth + 1, False), (left[k], depth + 1, False)]
        depth, rows = np.array(lengths, float).T
        return depth + c_factor(rows), tests

    def _mask(self, closed: tuple[int, int]) -> np.ndarray:
        """All bits but those of the leaves in ``closed``."""
        whole = (1 << 64 * self.words) - 1
        bits = whole & ~((1 << closed[1]) - (1 << closed[0]))
        return np.frombuffer(bits.to_bytes(8 * self.words, "little"), "<u8")

    def _chunk(self, trees: list, n_features: int):
        """(values, all leaves by word, per feature: sorted thresholds, each tree's mask number by rank, masks by word)."""
        values = np.zeros((len(trees), 64 * self.words))
        whole = np.array([~self._mask((0, len(lengths))) for lengths, _ in trees]).T[:, None, :].copy()
        features = []
        for f in range(n_features):
            cuts = np.unique([t for _, tests in trees for t, _, _ in tests.get(f, ())])
            ranks = np.zeros((len(cuts) + 1, len(trees)), np.int64)
            first, masks = np.zeros(len(trees), np.int64), []
            for k, (lengths, tests) in enumerate(trees):
                values[k, :len(lengths)] = lengths
                own = sorted(tests.get(f, ()), key=lambda x: x[0])
                first[k] = len(masks)
                ranks[:, k] = np.searchsorted([x[0] for x in own], np.concatenate(([-np.inf], cuts)), side="right")
                below = [self._mask(left) for _, left, _ in own]        # value >= threshold: not to the left
                above = [self._mask(right) for _, _, right in own]      # value < threshold: not to the right
                open_all = self._mask((0, 0))
                after = [open_all]
                for m in reversed(above):
                    after.append(after[-1] & m)
                before = open_all
                for r in range(len(own) + 1):
                    masks.append(before & after[len(own) - r])
                    before = before & below[r] if r < len(own) else before
            if len(cuts):
                by_word = np.ascontiguousarray(np.array(masks).T)
                features.append((f, cuts, (ranks + first).astype(np.int32), by_word))
        return values, whole, features

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Sum over all trees of the path length of each row (NaN goes right)."""
        total = np.zeros(len(x))
        for a in range(0, len(x), self.ROWS):
            rows = x[a:a + self.ROWS]
            for values, whole, features in self.chunks:
                left = np.repeat(whole, len(rows), axis=1)
                for f, cuts, ranks, masks in features:
                    at = ranks.take(np.searchsorted(cuts, rows[:, f], side="right"), axis=0).astype(np.intp)
                    for w in range(self.words):
                        left[w] &= masks[w].take(at)
                # One bit is left in one of the words: its place is the number of bits below it.
                leaf = np.zeros(left.shape[1:], np.intp)
                for w in range(self.words):
                    leaf += np.where(left[w] != 0, 64 * w + np.bitwise_count(left[w] - np.uint64(1)), 0)
                total[a:a + self.ROWS] += values[np.arange(len(values)), leaf].sum(axis=1)
        return total


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame          # NODE_SCHEMA rows, collected (bounded size)
    feature_cols: list[str]
    psi: int
    n_trees: int
    score_min: float = 0.0
    score_max: float = 1.0

    def raw_score(self, spark) -> Column:
        """Column expression: raw score of the feature columns (higher = more normal)."""
        bc = spark.sparkContext.broadcast(ForestBits(self.nodes, len(self.feature_cols)))
        roots = self.nodes.loc[self.nodes["node"] == 0, "size"].to_numpy()
        c_psi = float(c_factor(roots).mean())      # of the rows the trees were grown on
        n_trees = self.n_trees

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            return pd.Series(-np.power(2.0, -(bc.value.path_lengths(x) / n_trees) / c_psi))

        return score(*[F.col(c) for c in self.feature_cols])

    def anomaly_score(self, raw: Column) -> Column:
        return normalized_anomaly(raw, self.score_min, self.score_max)


def normalized_anomaly(raw: Column, score_min, score_max) -> Column:
    """1 - (raw - min) / (max - min), clipped to [0, 1]; zero range -> 0."""
    lo = F.lit(score_min) if not isinstance(score_min, Column) else score_min
    hi = F.lit(score_max) if not isinstance(score_max, Column) else score_max
    denom = hi - lo
    val = F.lit(1.0) - (raw - lo) / denom
    return F.when(denom == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), val)))


def score_bounds(scored: DataFrame, raw: str = "raw_score") -> DataFrame:
    return scored.agg(F.min(raw).alias("score_min"), F.max(raw).alias("score_max"))


def fit(df: DataFrame, feature_cols: list[str], id_col: str = "transaction_id",
        n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES, seed: int = SEED,
        n_rows: int | None = None) -> IsolationForestModel:
    """Fit the forest; also learns the raw-score bounds on ``df``."""
    spark = df.sparkSession
    n = n_rows if n_rows is not None else df.count()
    psi = int(min(max_samples, n))
    if n == 0:
        raise ValueError("an isolation forest needs at least one row")
    draws = min(float(n_trees), CANDIDATE_FACTOR * n_trees * psi / n)     # trees a row enters, on average
    row = [F.col(id_col), *[F.col(c) for c in feature_cols]]
    unit = F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(1 << 30)) / F.lit(float(1 << 30))
    entered = F.floor(F.lit(draws) + unit).cast("int")
    # The trees of lowest hash; only rows that enter any tree hash them all.
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                                     lambda t: F.struct(F.xxhash64(F.lit(seed + 1), F.col("_row"), t).alias("_prio"),
                                                        t.alias("tree"))))
    entries = (df.select(F.xxhash64(F.lit(seed + 2), *row).alias("_row"), entered.alias("_k"), *feature_cols)
                 .filter("_k > 0")
                 .select(F.explode(F.slice(order, F.lit(1), F.col("_k"))).alias("_draw"), *feature_cols)
                 .groupBy("_draw", *feature_cols).agg(F.count(F.lit(1)).alias("_copies"))
                 .select("_draw.*", "_copies", *feature_cols))
    nodes = entries.groupBy("tree").applyInPandas(_fit_tree_fn(feature_cols, psi, seed), NODE_SCHEMA)
    model = IsolationForestModel(nodes.toPandas(), list(feature_cols), psi, n_trees)
    roots = model.nodes.loc[model.nodes["node"] == 0, "size"]
    if len(roots) < n_trees:
        raise ValueError(f"{n_trees - len(roots)} of {n_trees} trees drew no row; the rows are too much alike")
    b = score_bounds(df.select(model.raw_score(spark).alias("raw_score"))).first()
    model.score_min, model.score_max = float(b["score_min"]), float(b["score_max"])
    return model


def save(model: IsolationForestModel, spark, path: str) -> None:
    nodes = spark.createDataFrame(model.nodes, NODE_SCHEMA)
    nodes.coalesce(1).write.mode("overwrite").parquet(path + "/nodes")
    meta = spark.createDataFrame(
        [(",".join(model.feature_cols), model.psi, model.n_trees, model.score_min,
          model.score_max)],
        "features string, psi int, n_trees int, score_min double, score_max double")
    meta.coalesce(1).write.mode("overwrite").parquet(path + "/meta")


def load(spark, path: str) -> IsolationForestModel:
    m = spark.read.parquet(path + "/meta").first()
    nodes = spark.read.parquet(path + "/nodes").toPandas()
    return IsolationForestModel(nodes, m["features"].split(","), m["psi"], m["n_trees"],
                                m["score_min"], m["score_max"])
