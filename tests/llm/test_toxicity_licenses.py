"""Ordinal toxicity on held-out rows, licence scan against brute force."""

import random

import numpy as np
import pytest

from txsentry.llm import licenses as L
from txsentry.llm import toxicity as T

SF = "/root/testdata/sf0.1"
INSULTS = "idiot moron stupid pathetic worthless disgusting trash loser clown scum".split()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels.filter("doc_id % 3 != 0"))
    assert model.thresholds == sorted(model.thresholds)
    held = T.rate(docs.filter("doc_id % 3 = 0"), model).join(labels, "doc_id").collect()
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert len(toxic) > 100
    assert np.mean([r.rejected for r in toxic]) > 0.9
    assert np.mean([r.rejected for r in clean]) < 0.005
    insults = [(sum(w in INSULTS for w in T.WORD.findall(r.text.lower())), r.expected_severity) for r in held]
    assert np.corrcoef(*zip(*insults))[0, 1] > 0.5
    for r in held:
        assert 0 <= r.toxic_probability <= 1 and 0 <= r.expected_severity <= 3 and r.grade in range(4)


def test_gradient_fits_graded_data():
    rng = random.Random(2)
    rows = []
    for k in range(600):
        toxic = rng.random() < 0.3
        words = [f"w{rng.randrange(400)}" for _ in range(40)] + [rng.choice(INSULTS) for _ in range(rng.randint(1, 9))] * toxic
        rng.shuffle(words)
        rows.append((" ".join(words), int(toxic)))
    model = T.train(iter(rows[:400]))
    above = model.score([t for t, _ in rows[400:]])
    assert np.mean((above[:, 0] >= 0.5) == [bool(y) for _, y in rows[400:]]) > 0.98
    assert (np.diff(above, axis=1) <= 0).all()


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, None), (None, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    model = T.fit(edge_docs, labels)
    out = T.rate(edge_docs, model).collect()
    assert len(out) == edge_docs.count()
    assert len({r.toxic_probability for r in out if r.doc_id in (3, 4, 5)}) == 1
    assert not any(r.rejected for r in T.rate(edge_docs, T.fit(edge_docs, labels.limit(0))).collect())
    assert not any(r.rejected for r in T.rate(edge_docs, T.fit(no_docs, labels)).collect())
    assert T.rate(no_docs, model).collect() == []


def brute(text, templates):
    """Templates of which some stretch of twice its length holds enough shingles."""
    w, out = L.words_of(text), set()
    for name, t in templates.items():
        want = L.shingles(L.words_of(t))
        n = len(L.words_of(t))
        if want and any(len(want & L.shingles(w[i:i + n])) / len(want) >= L.SIMILARITY for i in range(len(w))):
            out.add(name)
    return out


def test_scan_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(300)] + "licensed under the license version work".split()
    docs = []
    for k in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 400))]
        for name in rng.sample(list(L.TEMPLATES), rng.randint(0, 3)):
            t = L.TEMPLATES[name].split()
            if rng.random() < 0.4 and len(t) > 12:
                t = t[:-1]
            at = rng.randint(0, len(w))
            w[at:at] = t
        docs.append((k, " ".join(w)))
    got = {}
    for r in L.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        words = L.words_of(docs[r.doc_id][1])
        want = L.shingles(L.words_of(L.TEMPLATES[r.license]))
        assert abs(len(L.shingles(words[r.first_word:r.end_word]) & want) / len(want) - r.containment) < 1e-9
    for k, t in docs:
        assert brute(t, L.TEMPLATES) <= got.get(k, set())


def test_band_settings():
    for j in (0.2, 0.5, 0.9):
        b = L.band_settings(j)
        assert 1 - (1 - j) ** b >= L.CERTAINTY > 1 - (1 - j) ** (b - 1)


def test_license_edges(spark, edge_docs, no_docs):
    assert L.scan_licenses(edge_docs).collect() == []
    assert L.scan_licenses(no_docs).collect() == []
    rows = [(1, "x " + L.TEMPLATES["MIT"]), (1, "x " + L.TEMPLATES["MIT"]), (None, L.TEMPLATES["GPL-3.0"] * 2), (2, None)]
    got = sorted((str(r.doc_id), r.license) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "MIT"), ("1", "MIT"), ("None", "GPL-3.0")]
    assert L.scan_licenses(edge_docs, {"short": "a b c", "long": "a b c d e f"}).count() == 4
