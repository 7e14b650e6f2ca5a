"""SentencePiece encoding and decoding as a relational lattice.

A text becomes ``▁`` + text with spaces as ``▁`` and is cut where no piece can
cross: between two characters that follow one another in no piece.  Distinct
cuts ("words") are encoded once:

1. their substrings up to the longest piece are exploded,
2. equi-joined to the piece table (a bounded vocabulary, broadcast); a
   character without a piece becomes its UTF-8 byte pieces,
3. the edges are grouped by word, and a higher-order ``aggregate`` folds
   Viterbi over them in the order of their ends: it holds the best edge into
   every position and its path's score; a second fold walks back.

Texts are read once, in blocks.  A block is kept as its distinct words and its
documents as numbers of words (compressed), in one written table; the words go
to the lattice and come back as the block's dictionary of ids, which is
co-grouped with its documents.  No vocabulary of the corpus is broadcast or
collected.

Scores: a unigram model's pieces carry log probabilities, and ``encode`` is
for these.  A merge model's pieces carry only their rank, and no sum of scores
gives its merge order: ``encode`` then takes Zipf's law, -ln(rank + 2), and
its ids are NOT the model's (README has figures).  ``encode_merges``, which the
registered query and the pipeline use, gives a merge model's own ids: it has no
lattice, but carries out the merges on each distinct token between spaces (best
rank first, then leftmost), remembers a bounded number of tokens in a task, and
shuffles nothing.  Time grows with n log n of a token's length.
Decoding restores the text exactly, apart from literal ``▁``, which stand for
spaces as in the library.

Defined cases: null and empty texts have no ids; repeated rows are all
returned; ties go to the longer piece, then the larger id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from txsentry.llm.common import batch_rows, col, written

SPACE = "▁"
BLOCK_CHARS = 8_000_000
PACK_ROWS = 200_000
TEXT_ROWS = 500
CACHED_TOKENS = 500_000
CACHED_CHARS = 64
RUN = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces(NamedTuple):
    """The piece table: (piece, id, score) rows and the ids of the 256 bytes."""
    rows: list[tuple[str, int, int]]      # score in millionths, so that sums are exact
    first_byte: int
    ranks: dict[str, int] | None = None   # of a merge model: 0 is merged first, equal ranks from the left

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = [model.get_score(i) for i in plain]
        ranks = all(s == int(s) and s <= 0 for s in scores)      # a merge model
        rows = [(model.id_to_piece(i), i, round((-np.log(2 - s) if ranks else s) * 1e6)) for i, s in zip(plain, scores)]
        order = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        merges = ranks and not any(map(model.is_unused, ids))      # unused pieces would be merged and split again
        return cls(rows, min(i for i in ids if model.is_byte(i)),
                   {model.id_to_piece(i): order[s] for i, s in zip(plain, scores)} if merges else None)

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    def pairs(self) -> set[str]:
        """Characters that follow one another in a piece; texts are cut between all others."""
        found = {p[i:i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)}
        if any(p[1] == SPACE and p[0] != SPACE for p in found):
            raise ValueError("pieces cross word starts")
        return found

    def text(self, ids) -> str:
        """Decode."""
        at = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p, i, _ in self.rows}
        at |= {self.first_byte + b: bytes([b]) for b in range(256)}
        return b"".join(at[i] for i in ids)[1:].decode("utf-8", "surrogatepass")


def tokens_of(text: str | None) -> list[str]:
    """The text's parts between spaces.  Each stands for ``▁`` and itself; of
    several spaces in a row, the first ones stay with the part after them."""
    if not text:
        return []
    plain = text.replace(SPACE, " ")
    if "  " not in " " + plain:
        return plain.split(" ")
    return [run[1:] for run in RUN.findall(SPACE + plain.replace(" ", SPACE))]


def words_of(token: str, pairs: set[str]) -> list[str]:
    whole = SPACE + token
    cuts = [0, *[i for i, pair in enumerate(map(add, whole, token), 1) if pair not in pairs], len(whole)]
    return [whole[i:j] for i, j in zip(cuts, cuts[1:])]


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids array<int>) of distinct ``words`` (column word), by Viterbi."""
    spark, reach = words.sparkSession, pieces.longest
    table = F.broadcast(spark.createDataFrame(pieces.rows, "piece string, id int, score long"))
    least = min(s for _, _, s in pieces.rows) - 10_000_000
    spans = (words.select("word", F.length("word").alias("n"))
             .select("word", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("end"))
             .select("word", "end", F.explode(F.sequence(F.lit(1), F.least(F.lit(reach), F.col("end")))).alias("len"))
             .withColumn("piece", F.expr("substring(word, end - len + 1, len)")))
    edges = (spans.join(table, "piece", "left").filter("id IS NOT NULL OR len = 1")
             .select("word", F.struct("end", "len", F.coalesce("score", F.lit(least).cast("long")).alias("score"),
                                      F.coalesce("id", F.lit(-1)).alias("id")).alias("edge")))
    # The words are hash-partitioned by their distinct; nothing moves here.
    lattice = edges.groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    # Fold forward: the state has the best edge into every position, with its
    # path's score: those behind, and the last one, which may still improve.
    # Every position has an edge of one character, so none is left out.
    behind = "if(e.len = 1, s.last, element_at(s.done, e.end - e.len + 1)).score"
    forward = ("aggregate(edges, named_struct('done', cast(array() as array<struct<score: bigint, len: int, id: int>>), "
               "'last', named_struct('score', 0L, 'len', 0, 'id', -1)), (s, e) -> if(e.end = size(s.done), "
               "named_struct('done', s.done, 'last', greatest(s.last, named_struct('score', "
               "element_at(s.done, e.end - e.len + 1).score + e.score, 'len', e.len, 'id', e.id))), "
               f"named_struct('done', concat(s.done, array(s.last)), 'last', named_struct('score', {behind} + e.score, "
               "'len', e.len, 'id', e.id))), s -> concat(slice(s.done, 2, size(s.done)), array(s.last)))")
    # Walk back: take the edge of every position that the path ends a piece at.
    backward = ("reverse(aggregate(sequence(size(back), 1), named_struct('at', size(back), 'out', cast(array() as array<struct<at: int, id: int>>)), "
                "(s, p) -> if(p = s.at, named_struct('at', p - element_at(back, p).len, "
                "'out', concat(s.out, array(named_struct('at', p, 'id', element_at(back, p).id)))), s), s -> s.out))")
    paths = lattice.select("word", F.expr(forward).alias("back")).select("word", F.expr(backward).alias("path"))
    byte_ids = (f"transform(sequence(1, length(encode(substring(word, x.at, 1), 'UTF-8'))), k -> "
                f"cast(conv(hex(substring(encode(substring(word, x.at, 1), 'UTF-8'), k, 1)), 16, 10) as int) + {pieces.first_byte})")
    return paths.select("word", F.expr(f"flatten(transform(path, x -> if(x.id >= 0, array(x.id), {byte_ids})))").alias("ids"))


def _packed(columns: dict[str, pa.Array]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def _mark(text: bytes) -> bytes:
    """Digest by which a decoded text is known again."""
    return hashlib.blake2b(text, digest_size=16).digest()


def _numbers() -> defaultdict:
    """A dict that numbers its keys from 0 in the order they are first asked for."""
    return defaultdict(count().__next__)


def _planes(numbers: np.ndarray) -> list[bytes]:
    """The four bytes of each number apart: they compress better so."""
    return [plane.tobytes() for plane in numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def _whole(planes: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4").astype(np.int64)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The lists ``which`` of (values, offsets), end to end."""
    sizes = offsets[which + 1] - offsets[which]
    starts = np.repeat(offsets[which] - _offsets(sizes)[:-1], sizes)
    return values[starts + np.arange(len(starts))]


class _Block:
    """Documents as lists of token numbers, and the tokens found in them."""

    def __init__(self):
        self.ids, self.marks, self.rows, self.tokens, self.size = [], [], [], _numbers(), 0

    def add(self, key: int | None, text: str | None) -> None:
        self.ids.append(key)
        self.marks.append(_mark((text or "").replace(SPACE, " ").encode("utf-8", "surrogatepass")))
        self.rows.append(np.fromiter(map(self.tokens.__getitem__, tokens_of(text)), np.int32))
        self.size += len(text or "")

    def packed(self, pairs: set[str]) -> tuple[list[str], bytes]:
        """The block's words, and its documents in terms of their numbers."""
        words = _numbers()
        n_words, flat = array("i"), array("i")
        for token in self.tokens:
            cuts = words_of(token, pairs)
            n_words.append(len(cuts))
            flat.extend(map(words.__getitem__, cuts))
        n_words, flat = np.array(n_words, np.int64), np.array(flat, np.int64)
        stream = np.concatenate([*self.rows, np.empty(0, np.int32)])
        often = np.argsort(-np.bincount(stream, minlength=len(n_words)), kind="stable")     # small numbers for frequent tokens
        rank = np.empty_like(often)
        rank[often] = np.arange(len(often))
        parts = {"id": pa.array([self.ids], pa.list_(pa.int64())), "mark": pa.array([self.marks], pa.list_(pa.binary()))}
        for name, numbers in (("size", np.array([len(r) for r in self.rows], np.int64)), ("token", rank[stream]),
                              ("n_words", n_words[often]), ("word", _gather(flat, _offsets(n_words), often))):
            parts[name] = pa.array([_planes(numbers)], pa.list_(pa.binary()))
        return list(words), _packed(parts)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_pieces, ids_crc32, decoded): one row per document;
    ``decoded`` tells that decoding the ids gives the text back.  Without
    ``with_ids`` the ids themselves are left out.
    """
    pairs = pieces.pairs()
    slim = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    layout = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("word", pa.string()), ("docs", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's distinct words with their numbers, and one row with its documents."""
        part, k, block = TaskContext.get().partitionId(), 0, _Block()

        def rows():
            words, docs = block.packed(pairs)
            number = (part << 33) + k
            for i in range(0, len(words), 20_000):
                some = words[i:i + 20_000]
                yield pa.RecordBatch.from_pydict({"block": [number] * len(some), "number": range(i, i + len(some)), "word": some,
                                                  "docs": [None] * len(some)}, schema=layout)
            yield pa.RecordBatch.from_pydict({"block": [number], "number": [-1], "word": [None], "docs": [docs]}, schema=layout)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                block.add(key.as_py(), text.as_py())
                if block.size >= BLOCK_CHARS:
                    yield from rows()
                    k, block = k + 1, _Block()
                    pa.default_memory_pool().release_unused()
        if block.ids:
            yield from rows()

    with batch_rows(docs.sparkSession, TEXT_ROWS):
        kept = written(slim.mapInArrow(cut, "block long, number int, word string, docs binary"), "blocks", compression="zstd")
    # One shuffle by word serves the distinct words and the join that spreads
    # their ids: the distinct words are taken behind it, and keep a column of
    # each kind, as both sides must ask it for the same columns.
    used = kept.filter("number >= 0 AND word IS NOT NULL").select("block", "number", "word").repartition("word")
    distinct = used.groupBy("word").agg(F.max("block").alias("last"), F.max("number").alias("highest"))
    known = encode_words(distinct.filter("last IS NOT NULL AND highest >= 0"), pieces)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Dictionary rows of a stretch of the partition, compressed by block."""
        schema = pa.schema([("block", pa.int64()), ("entries", pa.binary())])
        held: list[pa.RecordBatch] = []

        def rows():
            whole = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("number", "ascending")])
            block = whole.column("block").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                ids = whole.column("ids").slice(i, j - i).combine_chunks()
                number = whole.column("number").slice(i, j - i).to_numpy()
                columns = {"step": np.diff(number, prepend=0), "n_ids": ids.value_lengths().to_numpy(), "id": ids.flatten().to_numpy()}
                entries = _packed({c: pa.array([_planes(v)], pa.list_(pa.binary())) for c, v in columns.items()})
                yield pa.RecordBatch.from_pydict({"block": [int(block[i])], "entries": [entries]}, schema=schema)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK_ROWS:
                yield from rows()
                held.clear()
        if sum(b.num_rows for b in held):
            yield from rows()

    dictionary = used.join(known, "word").select("block", "number", "ids").mapInArrow(pack, "block long, entries binary")
    blocks = kept.filter("number < 0").select(F.col("block").alias("part"), "docs")

    names = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p, i, _ in pieces.rows}
    names |= {pieces.first_byte + b: bytes([b]) for b in range(256)}

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_pieces": [], "ids_crc32": [], "decoded": []} | ({"ids": []} if with_ids else {})
        number, n_ids, values = [], [], []
        for data in right.column("entries"):
            entries = _unpacked(data.as_py())
            step, n, v = (_whole(entries.column(c)[0].as_py()) for c in ("step", "n_ids", "id"))
            number.append(np.cumsum(step))
            n_ids.append(n)
            values.append(v.astype(np.int32))
        none = np.empty(0, np.int64)
        number, n_ids, values = (np.concatenate([*x, none.astype(t)]) for x, t in ((number, np.int64), (n_ids, np.int64), (values, np.int32)))
        # The list of word w is the one at place[w].
        place, starts = np.argsort(number), _offsets(n_ids)
        for data in left.column("docs"):
            block = _unpacked(data.as_py())
            size, token, n_words, word = (_whole(block.column(c)[0].as_py()) for c in ("size", "token", "n_words", "word"))
            ends, cuts, word = _offsets(size), _offsets(n_words), place[word]
            for k, (i, mark) in enumerate(zip(block.column("id")[0].as_py(), block.column("mark")[0].as_py())):
                ids = _gather(values, starts, _gather(word, cuts, token[ends[k]:ends[k + 1]]))
                text = b"".join(map(names.__getitem__, ids.tolist()))[1:]
                out["doc_id"].append(i)
                out["n_pieces"].append(len(ids))
                out["ids_crc32"].append(zlib.crc32(ids.astype("<i4").tobytes()))
                out["decoded"].append(_mark(text) == mark)
                if with_ids:
                    out["ids"].append(ids)
        kinds = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "decoded": pa.bool_(), "ids": pa.list_(pa.int32())}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded boolean" + (", ids array<int>" if with_ids else "")
    return blocks.groupBy("part").cogroup(dictionary.groupBy("block")).applyInArrow(assemble, schema)


def merged(word: str, ranks: dict[str, int]) -> list[str]:
    """The parts of ``word`` after all merges: always the pair of the best rank, of equal ranks the leftmost."""
    parts, n = list(word), len(word)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank = ranks.get
    queue = [r << 40 | i for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
    heapify(queue)
    while queue:
        key = heappop(queue)
        i = key & (1 << 40) - 1
        j = after[i]
        if not parts[i] or j == n or rank(parts[i] + parts[j]) != key >> 40:      # merged otherwise since
            continue
        both = parts[i] = parts[i] + parts[j]
        parts[j] = ""
        h, k = before[i], after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := rank(both + parts[k])) is not None:
                heappush(queue, r << 40 | i)
        if h >= 0 and (r := rank(parts[h] + both)) is not None:
            heappush(queue, r << 40 | h)
    return [p for p in parts if p]


class _Merges(dict):
    """Token -> its ids as bytes, merged when first asked for; short tokens are remembered."""

    def __init__(self, pieces: Pieces):
        self.ranks, self.first_byte = pieces.ranks, pieces.first_byte
        self.at = {p: np.array([i], "<i4").tobytes() for p, i, _ in pieces.rows}

    def __missing__(self, token: str) -> bytes:
        found = []
        for p in merged(SPACE + token, self.ranks):
            if p not in self.at:      # one character without a piece
                self.at[p] = np.array([self.first_byte + b for b in p.encode("utf-8", "surrogatepass")], "<i4").tobytes()
            found.append(self.at[p])
        ids = b"".join(found)
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = ids
        return ids


def encode_merges(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded, ids): one row per document, with
    the ids that a merge model's library gives."""
    if pieces.ranks is None:
        raise ValueError("not a merge model, or one with unused pieces")
    pieces.pairs()      # refuses pieces that cross word starts
    kinds = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "decoded": pa.bool_(), "ids": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Merges(pieces)
        names = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p, i, _ in pieces.rows}
        names |= {pieces.first_byte + b: bytes([b]) for b in range(256)}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                out = {c: [] for c in kinds}
                for i, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    data = b"".join(map(known.__getitem__, tokens_of(text)))
                    ids = np.frombuffer(data, "<i4")
                    back = b"".join(map(names.__getitem__, ids.tolist()))[1:]
                    out["doc_id"].append(i)
                    out["n_pieces"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(data))
                    out["decoded"].append(back == (text or "").replace(SPACE, " ").encode("utf-8", "surrogatepass"))
                    out["ids"].append(ids)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return (docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded boolean, ids array<int>"))
