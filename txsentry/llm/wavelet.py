"""Token ids of a corpus as wavelet matrices, one per shard.

Documents are encoded whole, in ascending id order, each followed by an end
id.  A shard is one row of a zstd-compressed Parquet file: for every bit of a
token id, from the highest, a packed bit plane (after each plane the tokens
with a 0 come first, in order), the number of zeros, and the ones before each
block of ``BLOCK`` bits; beside them the ids and lengths of its documents.
``Shard`` answers access, rank (counting) and select (occurrences) from these
planes without decoding; ``occurrences`` and ``token_counts`` are the Spark
jobs over all shards.

Order: null ids first, then ids ascending, equal ids by a hash of the text;
identical rows are interchangeable.  A partition is a range of that order and
shards are cut inside it at ``SHARD_TOKENS`` tokens, so no id, however
frequent, is gathered in one task.

Defined cases: a null text is an empty one (just its end id); an empty table
writes no shard and gives empty results; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from txsentry.llm.common import col, shuffle_parts
from txsentry.session import scratch_path

SHARD_TOKENS = 1 << 21
BLOCK = 512
BLOCK_BYTES = 4 << 20
CACHED_PIECES = 900_000

SCHEMA = ("part int, no int, n long, bits int, zeros array<long>, planes array<binary>, ranks array<binary>, "
          "doc_ids array<long>, lengths array<long>")


# Texts of these characters alone are cut into pieces here, by the tokenizer's
# own rule: ASCII and those Latin letters whose normal form and lower case are
# one letter each (the dotted capital I is not: it gains a mark).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"     # the tokenizer's
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_OTHER = f"[^\\t\\n\\r -~{_LATIN}]|<[|]"
_NO_LETTERS = f"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \\t\\n\\r0-9a-z{_LATIN}]+)"


class TextEncoder:
    """Whole texts through a tokenizer that encodes piece by piece.

    The tokenizer (normal form, white space, lower case; then pieces of
    letters, single digits or marks) never joins across pieces, nor across
    spaces.  So a text's ids are those of its pieces in a row: pieces are
    encoded by the library once and remembered (at most ``CACHED_PIECES``; of
    a full memory the older half stays, which holds the frequent ones).  Texts of plain characters are lower-cased and cut by Arrow
    (spaces around all that is no letter, then split at white space); their
    distinct pieces of a block are looked up once each.  Any other texts are
    cut at their spaces, and the words go whole through the library.  Words
    keep other white space, special tokens contain none and plain texts no
    ``<|``, so the result is the library's.

    New pieces go to the library many at a time: each ends in the one token
    that is an end of word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.word_end = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.by_piece = (bool(self.word_end.any()) and "Lowercase()" in str(self.tokenizer.normalizer)
                         and _SPLIT in str(self.tokenizer.pre_tokenizer))
        self.words: dict[str, bytes] = {"": b""}
        # Numbers of the pieces, and their ids in ``flat`` from ``starts`` on.
        self.pieces: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0
        self.starts = np.zeros(1 << 14, np.int64)       # the end of piece k is the start of k + 1

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        for k in range(0, len(new), 4096):
            part = new[k:k + 4096]
            ids = np.concatenate(self._ids([" ".join(part[i:i + 256]) for i in range(0, len(part), 256)]))
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer's pieces do not end in ends of words")
            n, used = len(self.pieces), self.used
            while used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while n + len(part) >= len(self.starts):
                self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.flat[used:used + len(ids)] = ids
            self.starts[n + 1:n + 1 + len(part)] = used + ends
            self.used += len(ids)
            self.pieces.update(zip(part, range(n, n + len(part))))

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text by pieces."""
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _NO_LETTERS, r" \1 "))
        coded = pc.dictionary_encode(cut.flatten())
        names = coded.dictionary.to_pylist()
        if len(self.pieces) > CACHED_PIECES:      # numbers are given in order: the older half stays
            self.pieces = dict(islice(self.pieces.items(), CACHED_PIECES // 2))
            self.used = int(self.starts[len(self.pieces)])
        self._learn([x for x in names if x not in self.pieces])
        # Piece numbers start at 1; 0 is the empty piece at a text's ends.
        number = np.fromiter(map(self.pieces.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]
        first = self.starts[number]
        sizes = np.where(number > 0, self.starts[number + 1] - first, 0)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        at = ends[np.asarray(cut.offsets) - cut.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _worded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text by words."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.words) > CACHED_PIECES:
            self.words = dict(islice(self.words.items(), CACHED_PIECES // 2))
        new = list(set().union(*cut) - self.words.keys())
        for k in range(0, len(new), 4096):
            part = new[k:k + 4096]
            self.words.update(zip(part, [x.tobytes() for x in self._ids(part)]))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, c)), self.kind) for c in cut]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = np.zeros(len(texts), bool)
        if self.by_piece:
            plain = ~pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        for rows, run in ((np.flatnonzero(plain), self._plain), (np.flatnonzero(~plain), lambda t: self._worded(t.to_pylist()))):
            if len(rows):
                for k, ids in zip(rows.tolist(), run(texts if len(rows) == len(texts) else texts.take(pa.array(rows)))):
                    out[k] = ids
        return out


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def build(tokens: np.ndarray, bits: int) -> dict:
    """Planes, zeros and block ranks of one shard's tokens."""
    planes, ranks, zeros = [], [], []
    now, words = tokens, BLOCK // 64
    for k in range(bits - 1, -1, -1):
        b = (now & tokens.dtype.type(1 << k)) != 0
        packed = np.packbits(b, bitorder="little")
        planes.append(packed.tobytes())
        whole = np.concatenate((packed, np.zeros(-len(packed) % (8 * words), np.uint8)))
        ones = np.bitwise_count(whole.view(np.uint64)).reshape(-1, words).sum(axis=1, dtype=np.uint32)
        ranks.append(np.concatenate(([0], np.cumsum(ones))).astype("<u4").tobytes())
        up = now[b]
        now = np.concatenate((now[~b], up))
        zeros.append(len(b) - len(up))
    return {"n": len(tokens), "bits": bits, "zeros": zeros, "planes": planes, "ranks": ranks}


class Shard:
    """Read access to one shard."""

    def __init__(self, row: dict):
        self.n, self.bits, self.zeros = row["n"], row["bits"], row["zeros"]
        self.planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
        self.ranks = [np.frombuffer(r, "<u4") for r in row["ranks"]]

    def _rank1(self, level: int, at: int) -> int:
        block = at // BLOCK
        a = block * BLOCK // 8
        rest = np.unpackbits(self.planes[level][a:(at + 7) // 8], bitorder="little")[:at - block * BLOCK]
        return int(self.ranks[level][block]) + int(rest.sum())

    def _rank(self, level: int, bit: int, at: int) -> int:
        ones = self._rank1(level, at)
        return self.zeros[level] + ones if bit else at - ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) zero or one."""
        counts = self.ranks[level].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * BLOCK, self.n) - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        a = block * BLOCK // 8
        bits = np.unpackbits(self.planes[level][a:a + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - counts[block]])

    def access(self, at: int) -> int:
        token = 0
        for level in range(self.bits):
            bit = int(self.planes[level][at >> 3] >> (at & 7) & 1)
            token = token << 1 | bit
            at = self._rank(level, bit, at)
        return token

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Range of ``token`` below the last plane, of its first ``upto`` places."""
        lo, hi = 0, upto
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            lo, hi = self._rank(level, bit, lo), self._rank(level, bit, hi)
        return lo, hi

    def rank(self, token: int, upto: int | None = None) -> int:
        """How often ``token`` is among the first ``upto`` tokens."""
        lo, hi = self._range(token, self.n if upto is None else upto)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence."""
        at = self._range(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def places(self, token: int) -> np.ndarray:
        """Positions of all occurrences, by one select per plane for all of them."""
        lo, hi = self._range(token, self.n)
        at = np.arange(lo, hi)
        for level in range(self.bits - 1, -1, -1) if hi > lo else ():
            bit = token >> (self.bits - 1 - level) & 1
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little")
            at = np.flatnonzero(bits == bit)[at - self.zeros[level] if bit else at]
        return at

    def tokens(self) -> np.ndarray:
        """All tokens, plane by plane from the last."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            b = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            z = self.zeros[level]
            up[~b] = now[:z]
            up[b] = now[z:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = up
        return now


def pieces(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes of text (column 1)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        bits = max(int(enc.tokenizer.get_vocab_size() - 1).bit_length(), end_id.bit_length())
        schema = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("n", pa.int64()), ("bits", pa.int32()),
                            ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
                            ("ranks", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())),
                            ("lengths", pa.list_(pa.int64()))])
        part, no, size = TaskContext.get().partitionId(), 0, 0
        ids, parts = [], []
        end = np.array([end_id], enc.kind)

        def shard():
            row = build(np.concatenate([x for p in parts for x in (p, end)]), bits)
            row |= {"part": part, "no": no, "doc_ids": ids, "lengths": [len(p) + 1 for p in parts]}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for some in pieces(batch):
                for i, e in zip(some.column(0).to_pylist(), enc.encode(some.column(1))):
                    ids.append(i)
                    parts.append(e)
                    size += len(e) + 1
                    if size >= shard_tokens:
                        yield shard()
                        ids, parts, size, no = [], [], 0, no + 1
        if parts:
            yield shard()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` and write their shards under ``path``."""
    scan = F.monotonically_increasing_id().alias("scan")
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"),
                       F.xxhash64(col(text_col)).alias("tie"), scan)
    order = ["id", "tie", "scan"]
    (rows.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order).select("id", "text")
     .mapInArrow(_shards(tokenizer, end_id, shard_tokens), SCHEMA)
     .write.option("compression", "zstd").parquet(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _with_start(shards: DataFrame) -> DataFrame:
    """(part, no, base): tokens of all shards before each."""
    slim = shards.select("part", "no", "n")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = slim.groupBy("part").agg(F.sum("n").alias("n"))      # one row per written partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    inside = Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return (slim.withColumn("i", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
            .select("part", "no", (F.col("p") + F.col("i")).alias("base")))


def documents_of(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): what the files say of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                raw = Shard(row).tokens().astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - row["lengths"]
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                m = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * m, pa.int32()), pa.array([row["no"]] * m, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(row["lengths"], pa.int64()),
                     pa.array(crc, pa.int64())], names=["part", "no", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(run, "part int, no int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return (rows.join(_with_start(shards), ["part", "no"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(position): every place of ``token`` in the whole sequence, by select."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                at = Shard(row).places(token)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(at), pa.int32()),
                                                  pa.array([row["no"]] * len(at), pa.int32()), pa.array(at, pa.int64())],
                                                 names=["part", "no", "at"])

    found = shards.mapInArrow(run, "part int, no int, at long")
    return found.join(_with_start(shards), ["part", "no"]).select((F.col("base") + F.col("at")).alias("position"))


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, count) for the given tokens, by rank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = Shard(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int32()), pa.array([s.rank(t) for t in tokens], pa.int64())],
                                                 names=["token", "count"])

    return shards.mapInArrow(run, "token int, count long").groupBy("token").agg(F.sum("count").alias("count"))


def encoded(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to a new place in the shared folder and read its documents back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return documents_of(read_shards(docs.sparkSession, path))
