"""Merge order against the SentencePiece library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from txsentry.llm import queries
from txsentry.llm import sentencepiece_lattice as L

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(spark, library, edge_docs, no_docs):
    rng = random.Random(5)
    texts = ["", None, "  two  spaces ", " " * 5000, "=-" * 300 + "a" * 700 + "日本 naïve 😀 ß\t\x00end", "éà ЖЖ ▁ literal ▁▁", "\n\n", " ",
             "<s> <0x0A> </s>", "It's 3.14, e.g. http://example.com/a_b?c=d."]
    texts += ["".join(rng.choice("aaeinrst  .,=-_é") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in L.encode_merges(rows, L.Pieces.load(PATH)).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == library.encode(t or "") and got[i].n_pieces == len(got[i].ids) and got[i].decoded
    assert L.encode_merges(edge_docs, L.Pieces.load(PATH)).count() == edge_docs.count()
    assert L.encode_merges(no_docs, L.Pieces.load(PATH)).collect() == []


def test_registered_query_returns_the_library_ids(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_sentencepiece_lattice(spark, SF).collect()
    assert len(rows) == len(texts) and all(list(r.ids) == library.encode(texts[r.doc_id]) for r in rows)


def test_a_long_run_is_one_token(library):
    pieces = L.Pieces.load(PATH)
    run = " " * 300_000
    assert L.tokens_of(run) == [L.SPACE * 300_000]
    at = {p: i for p, i, _ in pieces.rows}
    assert [at[p] for p in L.merged(L.SPACE + L.tokens_of(run)[0], pieces.ranks)] == library.encode(run)


def test_a_model_without_ranks_is_refused(spark, no_docs):
    with pytest.raises(ValueError):
        L.encode_merges(no_docs, L.Pieces([("a", 300, -5)], 3))
