"""The SentencePiece lattice against a plain Viterbi, and the pipeline's stages."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txsentry.llm import sentencepiece_lattice as L
from txsentry.llm import simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return L.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def viterbi(s, pieces):
    at = {p: (i, x) for p, i, x in pieces.rows}
    least, reach = min(x for _, _, x in pieces.rows) - 10_000_000, pieces.longest
    best, back = [0], [None]
    for end in range(1, len(s) + 1):
        found = []
        for n in range(1, min(reach, end) + 1):
            p = s[end - n:end]
            if p in at or n == 1:
                i, x = at.get(p, (-1, least))
                found.append((best[end - n] + x, n, i))
        top = max(found)
        best.append(top[0])
        back.append(top)
    out, end = [], len(s)
    while end:
        _, n, i = back[end]
        out = ([i] if i >= 0 else [pieces.first_byte + b for b in s[end - 1].encode()]) + out
        end -= n
    return out


TEXTS = ["", None, "Hello world", "  two  spaces ", "line.\nNext, line; (x). don't...", "日本 naïve 😀 ß\t\x00end", "a" * 700,
         "It's 3.14, e.g. http://example.com/a_b?c=d.", "éà ЖЖ ▁ literal", "\n\n", " "]


def test_cuts_keep_the_text_and_the_best_path(pieces):
    pairs = pieces.pairs()
    for t in filter(None, TEXTS):
        whole = L.SPACE + t.replace(" ", L.SPACE)
        words = [w for token in L.tokens_of(t) for w in L.words_of(token, pairs)]
        assert "".join(words) == whole
        assert sum((viterbi(w, pieces) for w in words), []) == viterbi(whole, pieces)


def test_encode_equals_plain_viterbi(spark, pieces, edge_docs, no_docs):
    rng = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(100 + k, " ".join("".join(rng.choice("abcdeé.,") for _ in range(rng.randint(1, 9)))
                                                         for _ in range(rng.randint(0, 30)))) for k in range(40)]
    got = {r.doc_id: r for r in L.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), pieces).collect()}
    for i, t in rows:
        want = viterbi(L.SPACE + t.replace(" ", L.SPACE), pieces) if t else []
        assert list(got[i].ids) == want and got[i].n_pieces == len(want) and got[i].decoded
        assert pieces.text(got[i].ids) == (t or "").replace(L.SPACE, " ")
    assert L.encode(edge_docs, pieces).count() == edge_docs.count()
    assert L.encode(no_docs, pieces).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        seen[name] = spark.createDataFrame(out.collect(), docs.schema)
        now = seen[name]
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    start, clean, lines, single, mixed = (ids(x) for x in (docs, *seen.values()))
    assert clean <= start and lines == clean and single <= lines and set(mixed) <= set(single)
    fps = [simhash.simhash(r.text) for r in seen["simhash_near_dedup"].collect()]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    assert max(mixed.values()) <= 2
    final = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert Counter(r.doc_id for r in final) == mixed and all(r.decoded for r in final)


def test_pipeline_runs_as_a_query(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids"} <= set(out.columns) and out.agg(F.sum("n_pieces")).first()[0] > 1000
