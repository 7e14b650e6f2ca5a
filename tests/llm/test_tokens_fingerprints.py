"""Wavelet token files and fingerprints against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sf_paths import SF_MID
from txsentry.llm import fingerprints as P
from txsentry.llm import wavelet as W

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_wavelet_matrix_queries():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        t = rng.integers(0, 40, n).astype(np.uint16)
        s = W.Shard(W.build(t, 6))
        assert (s.tokens() == t).all()
        for i in range(0, n, 97):
            assert s.access(i) == t[i]
        for x in (0, 1, 17, 39, 63, 64):
            where = np.flatnonzero(t == x)
            assert s.rank(x) == len(where) and s.rank(x, n // 2) == (where < n // 2).sum()
            assert [s.select(x, k) for k in range(0, len(where), 7)] == where[::7].tolist()
            assert s.places(x).tolist() == where.tolist()


def check_texts(texts):
    t, enc = Tokenizer.from_file(PATH), W.TextEncoder(PATH)
    assert enc.by_piece
    for w, got, want in zip(texts, enc.encode(pa.array(texts)), t.encode_batch_fast(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids, repr(w)


def test_words_that_nfc_decomposes_equal_the_library():
    stems = ["\u09b9\u09df", "\u09a8\u09df", "\u091c\u095c", "\u0917\u095d", "\u05e9\ufb2a", "İ", "na\u00efve", "e\u0301", "Word", "日本"]
    check_texts([stem + end for stem in stems for end in ("", ".", ",", "...", ".,")])


def test_all_latin_letters_before_marks_equal_the_library():
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    ends = ["", "x", "é", "İ", ".", ",", "...", "$$$", "<|", "'s", "’", ".'s", "!?", "9", " 's", "'LL'd", "\u0301.", "\x1f.", "\xa0a"]
    check_texts([a + e for a in letters for e in ends] + [a + b for a in letters for b in letters][::7])


def test_random_ascii_equals_the_library():
    rng = random.Random(5)
    alphabet = "abCD'  .,!<|>09\n\t\r" + "strvemld'"
    check_texts(["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(20000)])


def test_every_word_of_a_table_equals_the_library(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    check_texts(texts)
    check_texts(sorted({w for t in texts for w in t.split()}))


def test_a_full_memory_is_filled_anew(monkeypatch):
    monkeypatch.setattr(W, "CACHED_PIECES", 3)
    t, enc = Tokenizer.from_file(PATH), W.TextEncoder(PATH)
    for text in ["one two three four", "five six one", "日本 x y z 日本", "two one", None, "日 本 a"]:
        assert enc.encode(pa.array([text], pa.string()))[0].tolist() == t.encode(text or "", add_special_tokens=False).ids


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("shard_tokens", [W.SHARD_TOKENS, 50])
def test_encoded_equals_the_library(spark, edge_docs, no_docs, tmp_path, shard_tokens):
    t = Tokenizer.from_file(PATH)
    extra = spark.createDataFrame(
        [(50, "It's <|endoftext|> and<|startoftext|>x <|ENDOFTEXT|>"), (51, "İİ K ΣΑΣ á \x1c\x85 　 tab\tnew\r\nline"),
         (52, "e\ń x"), (53, "日本語 text 123456 a1b2!?")], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(extra)
    path = str(tmp_path / "tokens")
    W.write_tokens(docs, path, PATH, shard_tokens=shard_tokens)
    shards = W.read_shards(spark, path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in W.documents_of(shards).collect())
    rows = docs.collect()
    ids = {(r.doc_id, r.text): t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows}
    digest = lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert sorted((str(d), *digest(x)) for (d, _), x in [((r.doc_id, r.text), ids[r.doc_id, r.text]) for r in rows]) == \
        sorted((str(d), n, c) for _, d, n, c in got)
    start = 0
    for s, _, n, _ in got:
        assert s == start
        start += n
    docs_in_order = [g[1] for g in got]
    assert docs_in_order == sorted(docs_in_order, key=lambda d: (d is not None, d or 0))
    counts = {r.token: r["count"] for r in W.token_counts(shards, [1, 7]).collect()}
    assert counts[1] == sum(x.count(1) for x in (ids[r.doc_id, r.text] for r in rows))
    ends = sorted(r.position for r in W.occurrences(shards, 1).collect())
    assert set(s + n - 1 for s, _, n, _ in got) <= set(ends) and len(ends) == counts[1]
    assert W.encoded(no_docs, PATH).collect() == []


def jaccard(a, b):
    def sh(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = sh(a), sh(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_likeness_estimates_jaccard():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    errors = []
    for n in (30, 80, 300, 1500):
        for _ in range(25):
            a = [rng.choice(vocabulary) for _ in range(n)]
            cut = rng.randint(0, n)
            b = a[:cut] + [rng.choice(vocabulary) for _ in range(n - cut)]
            a, b = " ".join(a), " ".join(b)
            x, y = P.codes([a, b])
            assert (P.unpacked(P.packed(x)) == x).all()
            errors.append(P.likeness(x, y) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprint_documents(spark, edge_docs, no_docs):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 80)))) for i in range(0, 400, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in P.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        e = t[:len(t) - q] + n[:q]
        a, b, c = P.codes([t, e, n])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (P.packed(a), P.packed(b))
        assert (r.near_edited, r.near_next) == (P.likeness(a, b), P.likeness(a, c))
    edge = P.fingerprint_documents(edge_docs).collect()
    assert len(edge) == edge_docs.count()
    assert {r.fingerprint for r in edge if r.doc_id in (3, 4, 5)} == {""}
    assert len({r.fingerprint for r in edge if r.doc_id == 1}) == 1
    one = P.fingerprint_documents(docs.filter("doc_id = 2")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert P.fingerprint_documents(no_docs).collect() == []
