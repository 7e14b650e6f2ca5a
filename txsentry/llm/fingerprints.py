"""Document fingerprints by one-permutation MinHash.

Texts have A-Z lower-cased and are cut into words at ASCII white space; the
distinct shingles of five words (fewer words: the whole sequence) are hashed
once.  The top bits of a hash choose one of ``BINS`` bins, each bin keeps its
smallest hash.  An empty bin takes the value of the first non-empty bin of its
own random sequence of bins (optimal densification), and the lowest ``BITS``
bits of every bin are packed into the fingerprint, as hex.  Likeness is the
share m of equal bins, corrected for chance: (m - c) / (1 - c), c = 2^-BITS,
at least 0.

Defined cases: null or blank texts have the empty fingerprint, which is like
itself (1) and unlike all others (0); the order of documents is by id (nulls
first), equal ids by a hash of the text and then by place; the only document
of a table is followed by itself; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from txsentry.llm.common import col, shuffle_parts, written
from txsentry.llm.minhash import mix, shingle_hashes

WORDS = 5
BINS = 256
BITS = 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 56) - 1)
CHUNK_CHARS = 1 << 20


def _probe(attempt: int) -> np.ndarray:
    """The bin that each bin looks at in one attempt."""
    seed = np.arange(BINS, dtype=np.uint64) + np.uint64(attempt * BINS + 1)
    return (mix(seed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)


def codes(texts: list[str | None]) -> list[np.ndarray | None]:
    """One array of ``BINS`` small codes per text, None where it has no words."""
    bins = np.full((len(texts), BINS), _NONE, np.uint64)
    flat, keys, values = bins.reshape(-1), [], []
    for d, t in enumerate(texts):
        h = shingle_hashes((t or "").encode("utf-8", "surrogatepass").lower().split(), WORDS)
        keys.append((h >> np.uint64(56)).astype(np.int64) + d * BINS)
        values.append(h & _LOW)
    if texts:
        np.minimum.at(flat, np.concatenate(keys), np.concatenate(values))
    some = (bins != _NONE).any(axis=1)
    full = bins.copy()
    doc, at = np.nonzero((bins == _NONE) & some[:, None])
    attempt = 0
    while len(doc):
        found = bins[doc, _probe(attempt)[at]]
        hit = found != _NONE
        full[doc[hit], at[hit]] = found[hit]
        doc, at, attempt = doc[~hit], at[~hit], attempt + 1
    small = (full & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return [small[d] if some[d] else None for d in range(len(texts))]


def packed(code: np.ndarray | None) -> str:
    if code is None:
        return ""
    return (code[0::2] << 4 | code[1::2]).astype(np.uint8).tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    b = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack((b >> 4, b & 15), axis=1).reshape(-1)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    chance = 2.0 ** -BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
                    ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
DDL = ("part int, kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
       "edited_fingerprint string, near_edited double, near_next double, text string")
ROW, HEAD, TAIL = 0, 1, 2


def _finished(part, doc, code, following, following_code, edit=None) -> dict:
    i, text = doc
    new = edited(text, following)
    edit = codes([new])[0] if edit is None else edit[0]
    return {"part": part, "kind": ROW, "doc_id": i, "n_chars": len(text),
            "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": packed(code), "edited_fingerprint": packed(edit),
            "near_edited": likeness(code, edit), "near_next": likeness(code, following_code), "text": None}


def _open(part, kind, doc, code) -> dict:
    return dict.fromkeys(SCHEMA.names) | {"part": part, "kind": kind, "doc_id": doc[0], "text": doc[1], "fingerprint": packed(code)}


def _chunks(batches):
    docs, size = [], 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            t = texts[k].as_py() or ""
            docs.append((ids[k].as_py(), t))
            size += len(t)
            if size >= CHUNK_CHARS:
                yield docs
                docs, size = [], 0
    if docs:
        yield docs


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish every document of a sorted partition but the last, whose follower
    is in another one; hand on the first and the last with their texts."""
    part, held, held_code = TaskContext.get().partitionId(), None, None
    for docs in _chunks(batches):
        found = codes([t for _, t in docs])
        out = [_open(part, HEAD, docs[0], found[0])] if held is None else []
        line = ([(held, held_code)] if held else []) + list(zip(docs, found))
        edits = codes([edited(a[1], b[1]) for (a, _), (b, _) in zip(line, line[1:])])
        out += [_finished(part, a, ca, b[1], cb, (e,)) for (a, ca), (b, cb), e in zip(line, line[1:], edits)]
        held, held_code = line[-1]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
    if held:
        yield pa.RecordBatch.from_pylist([_open(part, TAIL, held, held_code)], schema=SCHEMA)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_finished(r["part"], (r["doc_id"], r["text"]), unpacked(r["fingerprint"]), r["next_text"], unpacked(r["next_fp"]))
               for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next), one row per document."""
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"),
                       F.xxhash64(col(text_col)).alias("tie"), F.monotonically_increasing_id().alias("scan"))
    order = ["id", "tie", "scan"]
    ranged = (rows.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
              .select("id", "text"))
    seen = written(ranged.mapInArrow(_along, DDL), "fingerprints")
    # One head and one tail per non-empty partition: only their numbers are ordered.
    heads = seen.filter(F.col("kind") == HEAD)
    parts = heads.select("part")
    in_order = Window.orderBy("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(in_order),
                                              F.first("part").over(in_order)).alias("next_part"))
    firsts = heads.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    tails = (seen.filter(F.col("kind") == TAIL).select("part", "doc_id", "text", "fingerprint")
             .join(follows, "part").join(firsts, "next_part"))
    done = seen.filter(F.col("kind") == ROW).unionByName(tails.mapInArrow(_across, DDL))
    return done.drop("part", "kind", "text")
