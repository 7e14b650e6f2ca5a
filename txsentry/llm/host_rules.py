"""Quality rules on documents and on the hosts they come from.

Words are what stands between ASCII white space (space, tab to carriage
return).  Every document is measured whole: words, their code points, symbols
``#*$%&|<>``, lines with a word that equal an earlier line, and words that lie
in a window of three words found twice or more in the text.  The base rules
reject documents of fewer than ``MIN_WORDS`` words or with more than half of
their words in repeated windows.

Hosts: for each rule of ``RULES`` the failing documents of every host are
counted (partial sums, so a host of any size is one row per task).  A rule's
rate on a host is shrunk with a beta prior that is fitted to the rates of all
hosts by moments (Kleinman's estimator: the variance between hosts is what
the binomial variance leaves over); hosts with few documents thus stay near
the corpus rate.  A host is rejected when, for some rule, the posterior rate
less ``SURE`` posterior standard deviations still exceeds the rule's limit;
its documents go, whatever their own measures.  So documents of hosts that
are clean or merely small are kept.

The host of a document is its source; of a source that is an address, the
name between ``://`` (and any user) and the next ``/``, ``?``, ``#`` or port.
Names are trimmed and lower-cased.

Verdicts return to the documents in two joins: hosts with at least 1/``SHARES``
of all documents (at most ``SHARES`` of them) by broadcast, the others on the
host, where no key holds more than that share.

Defined cases: a null text has no words (all measures 0, rejected); a null
or blank source is one host of its own; rows repeated with one id are
documents of their own; null ids stay null; an empty table gives an empty
result; columns of other names are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from txsentry.llm.common import batch_rows, col, written

MIN_WORDS = 50
MAX_REPEATED = 50        # per cent of the words in repeated windows
SURE = 2.0               # posterior standard deviations
SHARES = 4096
BATCH_ROWS = 500

# Rule -> (condition on the measures that fails it, limit of a host's rate).
RULES = {
    "few_words": (f"n_words < {MIN_WORDS}", 0.5),
    "repeated": (f"100 * n_repeat_words > {MAX_REPEATED} * n_words", 0.5),
    "word_length": ("n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "equal_lines": ("10 * n_dup_lines > 3 * n_lines", 0.5),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside a window that occurs twice or more, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, window):     # renumbered before each step, so products stay small
        key = np.unique(key * len(number) + ids[k:n + k], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k:n + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()            # bytes split at exactly the six ASCII white spaces
    if not words:
        return (0, 0, len(_SYMBOLS.findall(text)), 0, 0, 0)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else int(((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80).sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def measures(text: Column) -> Column:
    """The measures as a struct of longs."""
    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES)), columns=list(MEASURES))

    return of(text.cast("string"))


def host_of(source: Column) -> Column:
    """Host name of a source name or address."""
    name = F.lower(F.trim(source.cast("string")))
    # the part behind ://, up to a slash, query or fragment, less user and port
    part = F.regexp_replace(F.regexp_extract(name, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), r"^.*@|:\d*$", "")
    return F.coalesce(F.when(name.rlike("^[a-z][a-z0-9+.-]*://"), part).otherwise(name), F.lit(""))


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Rule -> (corpus rate, strength) of the beta prior, from one row of sums over all hosts."""
    sums = [e for r in RULES for e in (F.sum(r).alias(f"f_{r}"), F.sum(F.col(r).cast("double") * F.col(r) / F.col("docs")).alias(f"q_{r}"))]
    s = hosts.agg(F.sum("docs").cast("double").alias("total"), F.count("*").alias("k"),
                  F.sum(F.col("docs").cast("double") * F.col("docs")).alias("squares"), *sums).first()
    out = {}
    for r in RULES:
        if not s.total:
            return dict.fromkeys(RULES, (0.0, 1.0))
        mean = s[f"f_{r}"] / s.total
        noise = mean * (1 - mean)
        # sum of n (p - mean)^2 has the mean  noise (k - 1) + between (total - squares / total)
        between = 0.0
        if s.k > 1:
            between = (s[f"q_{r}"] - s.total * mean * mean - noise * (s.k - 1)) / (s.total - s.squares / s.total)
        # Hosts that differ no more than by chance share one rate.
        out[r] = (mean, max(noise / between - 1, 0.0) if between > 0 else s.total)
    return out


def host_rates(hosts: DataFrame) -> DataFrame:
    """``hosts`` (docs and one failure count per rule) with ``rate_<rule>``,
    the shrunk rate, and ``rejected``."""
    bad, rates = F.lit(False), []
    for r, (mean, strength) in priors(hosts).items():
        rate = (F.col(r) + mean * strength) / (F.col("docs") + strength)
        sd = F.sqrt(rate * (1 - rate) / (F.col("docs") + strength + 1))
        rates.append(rate.alias(f"rate_{r}"))
        bad = bad | (rate - SURE * sd > RULES[r][1])
    return hosts.select("host", "docs", *RULES, *rates, bad.alias("rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its measures, ``base_failed``, its host, the
    host's number of documents and verdict, and ``kept``."""
    spark = docs.sparkSession
    failed = F.expr(f"{RULES['few_words'][0]} OR {RULES['repeated'][0]}")
    with batch_rows(spark, BATCH_ROWS):
        rows = written(docs.select(col(id_col).alias("doc_id"), host_of(col(host_col)).alias("host"),
                                   measures(col(text_col)).alias("m")).select("doc_id", "host", "m.*")
                       .withColumn("base_failed", failed), "host-rules")
    counts = [F.count_if(F.expr(cond)).alias(r) for r, (cond, _) in RULES.items()]
    hosts = host_rates(written(rows.groupBy("host").agg(F.count("*").alias("docs"), *counts), "hosts"))
    total = hosts.agg(F.sum("docs")).first()[0] or 0
    large = F.col("docs") * SHARES >= total
    verdict = hosts.select("host", "docs", F.col("rejected").alias("host_rejected"), large.alias("large"))
    tops = F.broadcast(verdict.filter("large").drop("large"))      # at most SHARES rows
    first = rows.join(tops, "host", "left")
    rest = (first.filter("docs IS NULL").drop("docs", "host_rejected")
            .join(verdict.filter("NOT large").drop("large"), "host"))
    return (first.filter("docs IS NOT NULL").unionByName(rest)
            .select("doc_id", *MEASURES[:5], "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
                    "n_lines", "host", F.col("docs").alias("host_docs"), "host_rejected"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                  coalesce(lower(trim(source, ' ')), '') AS name FROM documents),
h AS (SELECT *, CASE WHEN regexp_matches(name, '^[a-z][a-z0-9+.-]*://')
                     THEN regexp_replace(regexp_extract(name, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:\d*$', '', 'g')
                     ELSE name END AS host,
             regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
e AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS p FROM h),
w AS (SELECT r, p, a, lead(a, 1) OVER d AS b, lead(a, 2) OVER d AS c FROM e WINDOW d AS (PARTITION BY r ORDER BY p)),
n AS (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM w WHERE b IS NOT NULL AND c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p + o) AS n_repeat_words FROM n, (VALUES (0), (1), (2)) v(o) WHERE k > 1 GROUP BY r),
m AS (SELECT h.r, doc_id, host, len(words)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in words]), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines FROM h LEFT JOIN rep ON h.r = rep.r),
hosts AS (SELECT host, count(*) AS docs, @counts@ FROM m GROUP BY host),
s AS (SELECT sum(docs)::DOUBLE AS total, sum(docs::DOUBLE * docs) AS squares, count(*) AS k, @sums@ FROM hosts),
st AS (SELECT *, @strengths@ FROM s),
p AS (SELECT host, docs, @rates@ FROM hosts, st),
v AS (SELECT host, docs, @verdict@ AS host_rejected FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (@base@) AS base_failed, NOT (@base@) AND NOT host_rejected AS kept, n_lines, m.host, docs AS host_docs, host_rejected
FROM m JOIN v ON m.host = v.host
"""


def _sql() -> str:
    def between(r):
        m = f"(f_{r} / total)"
        return f"(CASE WHEN k > 1 THEN (q_{r} - total * {m} * {m} - {m} * (1 - {m}) * (k - 1)) / (total - squares / total) END)"

    parts = {
        "counts": ", ".join(f"count(*) FILTER (WHERE {c}) AS {r}" for r, (c, _) in RULES.items()),
        "sums": ", ".join(f"sum({r}) AS f_{r}, sum({r}::DOUBLE * {r} / docs) AS q_{r}" for r in RULES),
        "strengths": ", ".join(f"CASE WHEN {between(r)} > 0 THEN greatest((f_{r} / total) * (1 - f_{r} / total) / {between(r)} - 1, 0)"
                               f" ELSE total END AS s_{r}" for r in RULES),
        "rates": ", ".join(f"({r} + f_{r} / total * s_{r}) / (docs + s_{r}) AS p_{r}, s_{r}" for r in RULES),
        "verdict": " OR ".join(f"p_{r} - {SURE} * sqrt(p_{r} * (1 - p_{r}) / (docs + s_{r} + 1)) > {lim}" for r, (_, lim) in RULES.items()),
        "base": f"{RULES['few_words'][0]} OR {RULES['repeated'][0]}",
    }
    text = SQL
    for k, v in parts.items():
        text = text.replace(f"@{k}@", v)
    return text


SQL = _sql()
