"""Toxicity severity by cumulative-link ordinal regression on sparse words.

A text's features are ``ln(1 + count)`` of its words (``\\w+``, lower case) and
of their stems (first 3 to 6 letters: languages inflect at the end), as far as
they are in the model's vocabulary.  One weight vector w is shared by ordered
thresholds t0 < t1 < t2: P(grade > j) = logistic(w.x - tj).  Reported are the
expected severity (sum of those probabilities), the most likely grade and the
probability of any toxicity; a text is rejected when that is at least 1/2.

The labels know toxic and not.  Grade 0 is not toxic; toxic texts get grade
1, 2 or 3 by terciles of how much they have of the features that mark toxic
texts in the sample (sum of ``ln(1 + count)``).

The model is fitted on a bounded sample of the labelled texts
(``SAMPLE_ROWS``, chosen by a hash of the id), near copies left out so that a
copied text counts once; the vocabulary has at most ``VOCABULARY`` features.
Scoring covers every whole text and needs no shuffle.

Defined cases: null or wordless texts have no features and get the score of
the intercepts; null labels and null ids are no training rows, an id labelled
both ways is toxic; without labels of both kinds nothing is toxic; repeated
rows score alike; input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from txsentry.llm.common import col, without
from txsentry.llm.minhash import mix, shingle_hashes

SAMPLE_ROWS = 8000
VOCABULARY = 4000
MIN_DOCS = 5         # a word of the vocabulary is in so many sample texts,
MIN_SHARE = 0.002    # and in this share of them,
MIN_Z = 3.0          # and its log odds are so many standard errors from 0
GRADES = 4
STEPS = 400
PENALTY = 2e-4
WORD = re.compile(r"\w+")
STEMS = (3, 4, 5, 6)
CACHED_WORDS = 500_000


def features_of(word: str) -> tuple[str, ...]:
    """The word and its stems; a stem is marked so that it differs from a word."""
    return (word, *[word[:n] + "-" for n in STEMS if len(word) >= n])


def features(words: list[str]) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words).items():
        for f in features_of(w):
            out[f] += n
    return out


class OrdinalModel(NamedTuple):
    words: list[str]            # the vocabulary: words and stems
    weights: list[float]
    thresholds: list[float]

    def score(self, texts, known: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
        """P(grade > j) per text and threshold.  ``known`` remembers the
        vocabulary entries of words between calls."""
        at = {w: k for k, w in enumerate(self.words)}
        known = {} if known is None else known
        eta = np.zeros(len(texts))
        for k, t in enumerate(texts):
            counts: Counter = Counter()
            for w in WORD.findall(t.lower()) if t else ():
                entries = known.get(w)
                if entries is None:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    entries = known[w] = tuple(at[f] for f in features_of(w) if f in at)
                if entries:
                    counts.update(entries)
            eta[k] = sum(self.weights[f] * np.log1p(n) for f, n in counts.items())
        return _logistic(eta[:, None] - np.array(self.thresholds)[None, :])


NEVER = OrdinalModel([], [], [20.0, 21.0, 22.0])


def _logistic(x):
    return 0.5 * (1 + np.tanh(x / 2))


def _distinct(texts: Iterator[tuple[str, int]]) -> list[tuple[Counter, int]]:
    """Feature counts and label of the texts that share no minimum shingle (of
    three permutations) with an earlier one: near copies share one."""
    seen: set[int] = set()
    out = []
    for text, toxic in texts:
        words = WORD.findall(text.lower())
        if not words:
            continue
        h = shingle_hashes([w.encode() for w in words], 5)
        marks = [int(mix(h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))).min()) for k in (1, 2, 3)]
        if not seen.intersection(marks):
            seen.update(marks)
            out.append((features(words), toxic))
    return out


def train(texts: Iterator[tuple[str, int]]) -> OrdinalModel:
    rows = _distinct(texts)
    toxic = np.array([t for _, t in rows], bool)
    if not toxic.any() or toxic.all():
        return NEVER
    in_toxic, in_clean = Counter(), Counter()
    for counts, t in rows:
        (in_toxic if t else in_clean).update(counts.keys())
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    odds = {w: np.log((in_toxic[w] + 0.5) / (n1 + 1)) - np.log((in_clean[w] + 0.5) / (n0 + 1))
            for w in in_toxic.keys() | in_clean.keys() if in_toxic[w] + in_clean[w] >= max(MIN_DOCS, MIN_SHARE * len(rows))}
    z = {w: abs(v) / np.sqrt(1 / (in_toxic[w] + 0.5) + 1 / (in_clean[w] + 0.5)) for w, v in odds.items()}
    words = sorted((w for w in z if z[w] >= MIN_Z), key=lambda w: (-z[w], w))[:VOCABULARY]
    if not words:
        return NEVER
    marking = {w for w in words if odds[w] > 2}

    # Grades of the toxic rows.
    amount = np.array([sum(np.log1p(c[f]) for f in marking & c.keys()) for c, _ in rows])
    cuts = np.quantile(amount[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (amount[:, None] > cuts[None, :]).sum(axis=1), 0)

    at = {w: k for k, w in enumerate(words)}
    doc = np.concatenate([np.full(len(c.keys() & at.keys()), k) for k, (c, _) in enumerate(rows)]).astype(np.int64)
    pairs = [(at[w], np.log1p(c[w])) for c, _ in rows for w in c.keys() & at.keys()]
    word = np.array([p for p, _ in pairs], np.int64)
    value = np.array([v for _, v in pairs])

    # Adam on the mean negative log likelihood; thresholds are t0 and the logs
    # of the steps above it, so they stay ordered.
    p = np.zeros(len(words) + GRADES - 1)
    p[-3] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    line = np.arange(len(rows))
    for step in range(1, STEPS + 1):
        w, t = p[:-3], np.cumsum(np.concatenate((p[-3:-2], np.exp(p[-2:]))))
        eta = np.bincount(doc, value * w[word], len(rows))
        s = np.column_stack((np.ones(len(rows)), _logistic(eta[:, None] - t[None, :]), np.zeros(len(rows))))
        d = s * (1 - s)
        prob = np.maximum(s[line, grade] - s[line, grade + 1], 1e-9)
        g_eta = -(d[line, grade] - d[line, grade + 1]) / prob / len(rows)
        g_t = np.zeros(GRADES + 1)
        np.add.at(g_t, grade, d[line, grade] / prob / len(rows))
        np.add.at(g_t, grade + 1, -d[line, grade + 1] / prob / len(rows))
        g_t = g_t[1:-1]
        g = np.concatenate((np.bincount(word, value * g_eta[doc], len(words)) + PENALTY * w,
                            [g_t.sum(), g_t[1:].sum() * np.exp(p[-2]), g_t[2] * np.exp(p[-1])]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    t = np.cumsum(np.concatenate((p[-3:-2], np.exp(p[-2:]))))
    return OrdinalModel(words, p[:-3].tolist(), t.tolist())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    marked = (labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull())
              .groupBy(col(id_col).alias("id")).agg(F.max((col(label_col) > 0).cast("int")).alias("toxic")))
    share = min(1.0, sample_rows / max(1, marked.count()))
    # About sample_rows ids, whatever the table's size ...
    chosen = F.broadcast(marked.filter(F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    found = (docs.select(col(id_col).alias("id"), col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
             .filter("text IS NOT NULL").join(chosen, "id"))
    # ... and about as many rows, should ids repeat.
    rows = found.count()
    if rows > 1.25 * sample_rows:
        found = found.filter(F.pmod(F.xxhash64(F.lit(9), "id", "text", "place"), F.lit(1 << 30)) < int(sample_rows / rows * (1 << 30)))
    sample = found.select("text", "toxic").repartition(1).sortWithinPartitions("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column(0), b.column(1)))
        yield pa.RecordBatch.from_pydict({"words": [model.words], "weights": [model.weights], "thresholds": [model.thresholds]},
                                         schema=pa.schema([("words", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())),
                                                           ("thresholds", pa.list_(pa.float64()))]))

    found = sample.mapInArrow(run, "words array<string>, weights array<double>, thresholds array<double>").collect()
    return OrdinalModel(*found[0]) if found else NEVER


def severity(model: OrdinalModel, text: Column) -> Column:
    """Struct of grade, expected_severity and toxic_probability."""
    known: dict[str, tuple[int, ...]] = {}

    @F.pandas_udf("grade int, expected_severity double, toxic_probability double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        above = model.score(texts, known)
        each = np.column_stack((1 - above[:, 0], above[:, :-1] - above[:, 1:], above[:, -1]))
        return pd.DataFrame({"grade": each.argmax(axis=1).astype(np.int32), "expected_severity": above.sum(axis=1),
                             "toxic_probability": above[:, 0]})

    return scored(text.cast("string"))


def rate(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus grade, expected_severity, toxic_probability and rejected."""
    out = ("grade", "expected_severity", "toxic_probability")
    s = "_severity"
    while s in docs.columns:
        s += "_"
    rated = docs.withColumn(s, severity(model, col(text_col)))
    return rated.select(*without(docs, *out, "rejected"), *[F.col(f"{s}.{c}") for c in out],
                        (F.col(f"{s}.toxic_probability") >= 0.5).alias("rejected"))
