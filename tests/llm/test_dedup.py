"""Line dedup and SimHash near-dedup against brute force."""

import random
from collections import defaultdict

import pytest
import xxhash

from txsentry.llm import simhash as S
from txsentry.llm.components import components
from txsentry.llm.line_dedup import dedup_lines


def lines_removed(docs, window=3):
    """docs: [(order key, text)] in corpus order -> texts after the dedup."""
    seen, out = set(), []
    for _, text in docs:
        lines = None if text is None else text.split("\n")
        gone = set()
        for p in range(len(lines or []) - window + 1):
            w = tuple(lines[p:p + window])
            if w in seen:
                gone |= set(range(p, p + window))
            seen.add(w)
        out.append(None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 9)))) for i in range(300)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed)
           for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    for (i, text), want in zip(docs, lines_removed(docs)):
        assert got[i][0] == want
        assert got[i][1] == text.count("\n") + 1
        kept = 0 if not want and got[i][2] == got[i][1] else want.count("\n") + 1
        assert got[i][1] - got[i][2] == kept


def test_line_dedup_edges(edge_docs, no_docs):
    out = dedup_lines(edge_docs)
    assert sorted(c for c in out.columns if c not in ("n_lines", "n_removed")) == \
        sorted(c for c in edge_docs.columns if c not in ("n_lines", "n_removed"))
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert sorted(r.text for r in by[1]) == ["", ""]                       # the null id comes first
    assert sorted(r.text or "" for r in by[None]) == ["", "a b c\nd e f\ng h i\nj k l"]
    assert "x" in [r.text for r in by[2]]
    assert by[3][0].text is None and by[3][0].n_lines == 0
    assert by[4][0].text == "" and by[4][0].n_lines == 1
    assert by[6][0].text.count("\n") + 1 == 700 and by[7][0].text == "line 499 of a very long text end"
    assert by[8][0].text == "same" and by[8][0].n_removed == 4
    assert dedup_lines(no_docs).collect() == []


def brute_fp(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps, bits=2):
    """[(id, fp)] -> component id (smallest id) of every row."""
    label = list(range(len(fps)))
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(fps))], [find(i) for i in range(len(fps))]


def test_simhash_rule():
    for text in ["", None, "one", "one Two", "One two Three", "a b c d e a b c d e a b c", "É é ß x\x0by\x1cz w", "w " * 70000]:
        assert S.simhash(text) == brute_fp(text)


@pytest.mark.parametrize("bucket", [64, 1])
def test_links_equal_all_pairs(spark, bucket):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(25)]
    fps = set(centres) | {0}
    for c in centres:
        for _ in range(12):
            x = c
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = [(i, f) for i, f in enumerate(sorted(fps))]
    nodes = spark.createDataFrame([(S._signed(f),) for _, f in fps], "fp long")
    edges = S.links(nodes, bucket)
    u = 1 << 64
    assert all(((r.u % u) ^ (r.v % u)).bit_count() <= 2 for r in edges.collect())
    got = {r.node % u: r.root for r in components(edges, "u", "v").collect()}
    want, _ = brute_components(fps)
    groups, brute = defaultdict(set), defaultdict(set)
    for (i, f), c in zip(fps, want):
        groups[got.get(f, ("alone", f))].add(f)
        brute[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_near_duplicates_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    fps = [(d, brute_fp(t)) for d, t in rows]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(fps, brute_components(fps)[0]))
    got = S.near_duplicates(edge_docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = S.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == len(set(brute_components(fps)[1]))
    assert S.near_duplicates(no_docs).collect() == [] and S.keep_one(no_docs).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 901)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}
