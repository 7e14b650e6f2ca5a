"""op12: measures and verdicts against plain Python."""

import re
from collections import Counter

import pytest

from sf_paths import SF_SMALL
from txsentry.llm import host_rules
from txsentry.llm.queries import op12_host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


TEXTS = [None, "", " \t\n", "a", "a b", "a b c a b c", "a a a a", "x\x85y z\x1cw v", "ß 😀 naïve\nß 😀 naïve\n\nß 😀 naïve ", "#*$%&|<> ## a|b",
         "one two three four\none two three four\r\n", "w " * 5000, "\n".join(f"line {i % 90}" for i in range(3000)), "q\x0bq\x0cq q q q"]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_measures(k):
    assert host_rules.measure(TEXTS[k]) == brute(TEXTS[k])


def test_query_measures(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = op12_host_rules(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and not r.host_rejected)


def good(i):
    return " ".join(f"word{i}x{k}" for k in range(60))


def site_docs(spark):
    bad = "# | # " * 40
    rows = [(i, good(i), "https://User@Good.example.org:80/p?q") for i in range(40)]
    rows += [(100 + i, bad + good(i) if i < 38 else good(i), " bad.example.org") for i in range(40)]
    rows += [(200 + i, "# # " * 30 + good(i), f"http://small{i}.example.org/#x") for i in range(2)]
    rows += [(300 + k, good(300 + k), f"http://tiny{k}.example.net/") for k in range(30)]
    rows += [(400, good(400), None), (401, None, None), (None, good(1), "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_hosts(spark):
    got = {r.doc_id: r for r in host_rules.judge(site_docs(spark)).collect()}
    assert got[0].host == "good.example.org" and got[0].host_docs == 40 and got[0].kept
    # clean documents of a rejected host go too, a host of one document is not judged by it
    assert got[139].host_rejected and not got[139].base_failed and not got[139].kept
    assert got[200].host == "small0.example.org" and not got[200].host_rejected
    assert all(got[300 + k].kept for k in range(30))
    assert got[400].host == "" and got[400].host_docs == 3 and got[400].kept and not got[401].kept and got[None].kept
    assert len(got) == 115


def test_rare_hosts_joined_apart(spark, monkeypatch):
    want = sorted(host_rules.judge(site_docs(spark)).collect(), key=str)
    monkeypatch.setattr(host_rules, "SHARES", 4)       # only the two large hosts by broadcast
    assert sorted(host_rules.judge(site_docs(spark)).collect(), key=str) == want


def test_prior_pulls_small_hosts(spark):
    rows = [(f"h{k}", 100, 5, 0, 0, 0, 0) for k in range(20)] + [("bad", 100, 95, 0, 0, 0, 0), ("one", 1, 1, 0, 0, 0, 0)]
    hosts = spark.createDataFrame(rows, "host string, docs long, " + ", ".join(f"{r} long" for r in host_rules.RULES))
    got = {r.host: r for r in host_rules.host_rates(hosts).collect()}
    assert got["bad"].rejected and not got["one"].rejected and not got["h0"].rejected
    assert 0.05 < got["one"].rate_few_words < 1 and got["bad"].rate_few_words < 0.95


def test_edges(spark, edge_docs, no_docs):
    rows = edge_docs.collect()
    got = host_rules.judge(edge_docs).collect()
    assert len(got) == len(rows)
    want = Counter((r.doc_id, *brute(r.text)) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in got) == want
    assert host_rules.judge(no_docs).count() == 0
