"""Prefix trie of conversations, built as adaptive radix trees.

A turn is a fixed-width, big-endian id of ``TURN_BYTES`` bytes (the first
bytes of a SHA-256 of role and text), a conversation the string of its turns'
ids.  The strings are range-partitioned and sorted; every task builds adaptive
radix trees over runs of at most ``TREE_ROWS`` of them: nodes hold 4, 16, 48
or 256 children and grow from one layout to the next, and a path without a
branch is kept as one string.  A tree emits a trie node wherever a path
reaches a depth that is a whole number of turns, no others.

A node inside one tree is final.  Nodes on the path of a tree's first or last
string may also lie in the neighbouring trees; these parts (two paths a tree)
are summed by node, and their subtree sums follow by pointer doubling, so that
neither a first turn that all conversations share nor thousands of equal
conversations meet in one task.  A conversation longer than ``SEGMENT`` turns
goes on in a tree of the next layer, below the node that it has reached, so
no row or path grows with a conversation.  Nodes are told apart across tasks
by their depth and the exclusive or of hashes of (place, turn) along the path.

``rebuild`` gives conversations the shared heads that the query asks for.

Defined cases: null role or text is an empty one; null turns come first,
turns of one number in the order of their ids; rows without a conversation id
belong to no conversation; a conversation without turns is a member of the
root; an empty table gives an empty result; columns of other names are not
read.  The hash of a node's members is one SHA-256, which has to be fed in
order: for one node it is fed by one task, in chunks of ``CHUNK_IDS`` ids.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from txsentry.llm.common import col, shuffle_parts, written
from txsentry.llm.mixing import word_count

TURN_BYTES = 16
SEGMENT = 64            # turns of one key
TREE_ROWS = 1 << 14     # keys of one tree
CHUNK_IDS = 4096
SUPER = 4096            # blocks of one step of a prefix over blocks
EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- turns

def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv, turn, id, words): one slim row per turn, texts replaced by their ids."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # The role's length in front keeps (role, text) pairs apart.
    name = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    ident = F.unhex(F.substring(F.sha2(name, 256), 1, 2 * TURN_BYTES))
    return rows.filter(col(conv_col).isNotNull()).select(
        col(conv_col).cast("long").alias("conv"), col(turn_col).alias("turn"), ident.alias("id"), word_count(text).alias("words"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of head and own rows so far, per conversation, in a sorted partition."""
    part, last, held = TaskContext.get().partitionId(), None, (0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, kind = (batch.column(k).to_numpy() for k in (0, 1))
        new = np.concatenate(([conv[0] != last if last is not None else True], conv[1:] != conv[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
        out = []
        for k, carried in ((1, held[0]), (2, held[1])):
            total = np.concatenate(([0], np.cumsum(kind == k)))
            out.append(np.where(start >= 0, total[1:] - total[np.maximum(start, 0)], total[1:] + carried))
        last, held = conv[-1], (int(out[0][-1]), int(out[1][-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.full(len(conv), part, np.int64)), pa.array(out[0]), pa.array(out[1]),
             batch.column(2), batch.column(3)], names=["conv", "kind", "part", "n_head", "n_own", "id", "words"])


def rebuild(rows: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """(conv, pos, id, words): conversation c as the first h turns of
    conversation c - c % ``block`` followed by its own turns after its first h,
    h = crc32(c) % ``heads``; pos counts from 1, and one row of pos null tells
    that c exists.

    Every conversation, however long, is numbered over as many tasks as its
    rows lie in: rows are sorted over all tasks and counted within each, and
    only the counts of conversations that cross a border are added up.
    """
    spark = rows.sparkSession
    slim = written(rows, "trie-turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    first = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "id")
    top = (slim.filter(F.col("conv") % block == 0).withColumn("rn", F.row_number().over(first)).filter(F.col("rn") < heads)
           .select(F.col("conv").alias("base"), "rn", "id", "words"))
    convs = slim.select("conv").distinct()
    given = (convs.withColumn("base", F.col("conv") - F.col("conv") % block).withColumn("h", h).join(top, "base")
             .filter("rn <= h"))
    turn_type = slim.schema["turn"].dataType
    none = F.lit(None).cast(turn_type)
    row = ["conv", "kind", "id", "words", "turn", "rn"]
    both = (convs.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("words"),
                         none.alias("turn"), F.lit(0).alias("rn"))
            .unionByName(given.withColumn("kind", F.lit(1)).withColumn("turn", none).select(*row))
            .unionByName(slim.withColumn("kind", F.lit(2)).withColumn("rn", F.lit(0)).select(*row))
            .withColumn("scan", F.monotonically_increasing_id()))
    order = ["conv", "kind", F.col("turn").asc_nulls_first(), "rn", "id", "scan"]
    dealt = both.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).select(*row[:4])
    done = written(dealt.mapInArrow(_number, "conv long, kind int, part long, n_head long, n_own long, id binary, words long"), "trie-numbered")

    # One row per task: its first and last conversation, and what it counted of the last.
    edge = (done.groupBy("part").agg(F.min("conv").alias("head"), F.max(F.struct("conv", "n_own", "n_head")).alias("tail"))
            .select("part", "head", F.col("tail.conv").alias("tail"), F.col("tail.n_own").alias("own"), F.col("tail.n_head").alias("given")))
    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumns({c + "0": F.sum(c).over(before) for c in ("own", "given")})
    whole = edge.groupBy(F.col("tail").alias("t")).agg(F.sum("own").alias("t_own"), F.sum("given").alias("t_given"))
    inside = F.col("head") == F.col("tail")
    ahead = (edge.join(whole, F.col("head") == F.col("t"), "left")
             .select(F.col("part").alias("p"), F.col("head").alias("c"),
                     F.when(inside, F.col("own0")).otherwise(F.col("t_own")).alias("own"),
                     F.when(inside, F.col("given0")).otherwise(F.col("t_given")).alias("given"))
             .filter("own > 0 OR given > 0"))
    n_head = F.col("n_head") + F.coalesce("given", F.lit(0))
    n_own = F.col("n_own") + F.coalesce("own", F.lit(0))
    placed = (done.join(F.broadcast(ahead), (F.col("part") == F.col("p")) & (F.col("conv") == F.col("c")), "left")   # at most one row a task
              .withColumn("over", n_own - h))
    return (placed.filter("kind < 2 OR over > 0")
            .select("conv", F.when(F.col("kind") == 1, n_head).when(F.col("kind") == 2, n_head + F.col("over")).alias("pos"), "id", "words"))


# ---------------------------------------------------------------- segments

def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(layer, sa, sb, key, words, ma, mb, conv, more): the turns of a
    conversation in runs of ``segment``; (sa, sb) names the path before the
    run, (ma, mb) are the hashes of its (place, turn) pairs, ``more`` says that
    the conversation goes on."""
    own = F.when(F.col("pos").isNull(), F.lit(0)).otherwise(F.floor((F.col("pos") - 1) / segment)).cast("long")
    next_too = (F.col("pos") > 1) & ((F.col("pos") - 1) % segment == 0)     # tells the run before that it goes on
    at = F.explode(F.when(next_too, F.array(F.col("own") - 1, F.col("own"))).otherwise(F.array("own")))
    marks = [F.xxhash64(F.lit(k), "pos", "id").alias(n) for k, n in ((1, "a"), (2, "b"))]
    cut = rows.withColumn("own", own).select("conv", "pos", "id", "words", *marks, "own", at.alias("layer"))
    here = (F.col("layer") == F.col("own")) & F.col("pos").isNotNull()
    got = (cut.groupBy("conv", "layer")
           .agg(F.array_sort(F.collect_list(F.when(here, F.struct("pos", "id", "words", "a", "b")))).alias("t"),    # at most `segment`
                F.max(F.col("layer") < F.col("own")).alias("more"))
           .select("conv", "layer", "more", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["id"])), "")).alias("key"),
                   F.col("t.words").alias("words"), F.col("t.a").alias("ma"), F.col("t.b").alias("mb")))
    got = written(got, "trie-segments")
    if not got.filter("layer > 0").head(1):
        return got.withColumns({"sa": F.lit(0).cast("long"), "sb": F.lit(0).cast("long")})

    def xor(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))

    # Exclusive or over all runs before, in two steps, so that no window grows
    # with more than a conversation's length over SEGMENT x SUPER.
    full = got.filter("more").select("conv", "layer", F.floor(F.col("layer") / SUPER).alias("sup"), xor("ma").alias("xa"), xor("mb").alias("xb"))
    upto = Window.partitionBy("conv", "sup").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("sup").rowsBetween(Window.unboundedPreceding, -1)
    sups = full.groupBy("conv", "sup").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"))
    sups = sups.select("conv", "sup", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c + "0") for c in ("xa", "xb")])
    starts = (full.select("conv", "layer", "sup", *[F.bit_xor(c).over(upto).alias(c) for c in ("xa", "xb")]).join(sups, ["conv", "sup"])
              .select("conv", (F.col("layer") + 1).alias("layer"), F.col("xa").bitwiseXOR(F.col("xa0")).alias("sa"),
                      F.col("xb").bitwiseXOR(F.col("xb0")).alias("sb")))
    return written(got.join(starts, ["conv", "layer"], "left").fillna(0, ["sa", "sb"]), "trie-layers")


# ---------------------------------------------------------------- adaptive radix tree

class Node:
    """A node with its compressed path, an optional value and up to 256 children.

    Layouts 4 and 16 keep sorted bytes beside their children, layout 48 an
    index of 256 slots into 48 children, layout 256 a child per byte.
    """

    __slots__ = ("path", "value", "layout", "keys", "kids")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.layout, self.keys, self.kids = path, value, 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.keys):
                index[byte] = at + 1
            self.layout, self.keys = 48, index
        else:
            wide = [None] * 256
            for byte, at in enumerate(self.keys):
                if at:
                    wide[byte] = self.kids[at - 1]
            self.layout, self.keys, self.kids = 256, bytearray(), wide

    def add(self, byte: int, node: Node) -> None:
        """A child for a byte that has none yet."""
        if self.layout < 256 and len(self.kids) == self.layout:
            self.grow()
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.kids.insert(at, node)
        elif self.layout == 48:
            self.kids.append(node)
            self.keys[byte] = len(self.kids)
        else:
            self.kids[byte] = node

    def children(self) -> Iterator[Node]:
        """In the order of their bytes."""
        if self.layout <= 16:
            yield from self.kids
        elif self.layout == 48:
            yield from (self.kids[at - 1] for at in self.keys if at)
        else:
            yield from (k for k in self.kids if k is not None)

    def split(self, at: int) -> None:
        """Cut the compressed path: what lies behind byte ``at`` becomes a child."""
        low = Node(self.path[at + 1:], self.value)
        low.layout, low.keys, low.kids = self.layout, self.keys, self.kids
        byte, self.path = self.path[at], self.path[:at]
        self.value, self.layout, self.keys, self.kids = None, 4, bytearray(), []
        self.add(byte, low)


def insert(root: Node, key: bytes, value) -> None:
    """Put a new key into the tree (the root has an empty path)."""
    node, depth = root, 0
    while True:
        path = node.path
        if not key.startswith(path, depth):
            part = key[depth:depth + len(path)]
            differ = int.from_bytes(part, "big") ^ int.from_bytes(path[:len(part)], "big")
            node.split(len(part) - (differ.bit_length() + 7) // 8)
            path = node.path
        depth += len(path)
        if depth == len(key):
            node.value = value
            return
        below = node.child(key[depth])
        if below is None:
            node.add(key[depth], Node(key[depth + 1:], value))
            return
        node, depth = below, depth + 1


class _Run:
    """Equal keys: their hashes along the path, and who ends or goes on there."""

    __slots__ = ("ca", "cb", "words", "ends", "n", "low", "more", "no")

    def __init__(self, no, sa, sb, words, ma, mb):
        self.ca = np.bitwise_xor.accumulate(np.concatenate(([sa], ma)))
        self.cb = np.bitwise_xor.accumulate(np.concatenate(([sb], mb)))
        self.words, self.ends, self.n, self.low, self.more, self.no = words, [], 0, None, False, no


FIELDS = ("kind", "tree", "depth", "a", "b", "pa", "pb", "conv_id", "parent_conv_id", "parent_open", "n_convs", "n_children",
          "n_leaves", "saved_tokens", "words", "text")
PARTS = ("kind int, tree long, depth long, a long, b long, pa long, pb long, conv_id long, parent_conv_id long, parent_open boolean, "
         "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, text string")
CLOSED, OPEN, ENDS = 0, 1, 2


def emit(root: Node, tree: int, layer: int, last: int, open_left: bool, open_right: bool, segment: int = SEGMENT) -> list[list]:
    """Rows of ``FIELDS`` for the trie nodes of one tree, children first.

    ``last``: number of the tree's last run.  Open nodes (a path that a
    neighbouring tree or the next layer may share) get what lies closed below
    them; their member ids follow as ``ENDS`` rows.
    """
    out: list[list] = []
    order, stack = [], [(root, -1, 0)]
    while stack:                                    # parents before children
        node, up, above = stack.pop()
        end = above + len(node.path) + (up >= 0)    # one byte chose the node
        at = len(order)
        order.append((node, up, above, end))
        stack.extend((kid, at, end) for kid in node.children())
    # Per radix node, of what hangs below it: members, their least id, rows of
    # the topmost trie nodes, sums of the closed ones, a run, and openness.
    sums = [[0, None, [], 0, 0, 0, None, False] for _ in order]
    base = layer * segment
    for at in range(len(order) - 1, -1, -1):
        node, up, above, end = order[at]
        n, low, hang, closed, leaves, saved, rep, is_open = sums[at]
        run = node.value
        if run is not None:
            n, rep = n + run.n, run
            low = run.low if low is None else min(low, run.low)
            is_open = is_open or run.more or (open_left and run.no == 0) or (open_right and run.no == last)
        top = -1 if up < 0 else above // TURN_BYTES
        for d in range(end // TURN_BYTES, top, -1):  # turn-aligned depths on the edge to this node
            if d == 0:
                is_open = True
                if layer:                            # counted as the last node of the layer above
                    n, low = 0, None
            here = run if run is not None and d * TURN_BYTES == end else None
            words = int(rep.words[d - 1]) if d else 0
            a, b = int(rep.ca[d]), int(rep.cb[d])
            pa_, pb_ = (int(rep.ca[d - 1]), int(rep.cb[d - 1])) if d else (None, None)
            for k in hang:
                out[k][8:10] = (None, True) if is_open else (low, False)
            if is_open:
                row = [OPEN, tree, base + d, a, b, pa_, pb_, low, None, None, n, closed, leaves, saved, words, None]
                for k in range(0, len(here.ends) if here else 0, CHUNK_IDS):
                    ids = here.ends[k:k + CHUNK_IDS]
                    out.append([ENDS, tree, base + d, a, b, None, None, ids[0], None, None, len(ids), 0, 0, 0, 0, ",".join(map(str, ids))])
                closed = leaves = saved = 0
            else:
                leaves, saved = leaves + (not hang), saved + (n - 1) * words
                sha = hashlib.sha256(",".join(map(str, here.ends)).encode()).hexdigest() if here else EMPTY
                row = [CLOSED, tree, base + d, a, b, pa_, pb_, low, None, None, n, len(hang), leaves, saved, words, sha]
                closed = 1
            hang = [len(out)]
            out.append(row)
        if up >= 0:
            s = sums[up]
            s[0] += n
            if low is not None:
                s[1] = low if s[1] is None else min(s[1], low)
            s[2] += hang
            s[3], s[4], s[5], s[6], s[7] = s[3] + closed, s[4] + leaves, s[5] + saved, rep, s[7] or is_open
    return out


def _trees(segment: int, tree_rows: int):
    schema = pa.schema([(f, {"kind": pa.int32(), "parent_open": pa.bool_(), "text": pa.string()}.get(f, pa.int64())) for f in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        group = root = now = key = None
        rows, left = 0, True

        def finish(open_right: bool):
            got = emit(root, number, group[0], now.no, left, open_right, segment)
            for k in range(0, len(got), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got[k:k + 8192]), schema)], schema=schema)

        for batch in batches:
            layer, sa, sb, conv = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
            keys, more = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            lists = [(np.asarray(c.offsets), c.values.to_numpy()) for c in (batch.column(k) for k in (6, 7, 8))]
            for i in range(batch.num_rows):
                g = (layer[i], sa[i], sb[i])
                if g != group or rows >= tree_rows:
                    if root is not None:
                        yield from finish(g == group)
                        number, left = number + 1, g == group
                    group, root, now, rows, key = g, Node(b""), None, 0, None
                if keys[i] != key:
                    key = keys[i]
                    now = _Run(0 if now is None else now.no + 1, g[1], g[2], *[v[o[i]:o[i + 1]] for o, v in lists])
                    insert(root, key, now)
                rows += 1
                now.n += 1
                now.low = conv[i] if now.low is None else min(now.low, conv[i])
                if more[i]:
                    now.more = True
                else:
                    now.ends.append(conv[i])
        if root is not None:
            yield from finish(True)

    return run


# ---------------------------------------------------------------- whole trie

NODE = ["depth", "a", "b"]


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every node's chunks, in a partition sorted by node and first id."""
    node, sha, done = None, None, []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*NODE, "ends"])

    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(4)]
        for *at, text in zip(*cols):
            if at != node:
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = at, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        if len(done) >= 8192:
            yield rows()
            done = []
    if node is not None:
        done.append((*node, sha.hexdigest()))
        yield rows()


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """(depth, a, b, leaves, saved): ``leaves`` and ``saved`` of ``nodes``
    summed over each node's subtree, by pointer doubling."""
    up = ["up_a", "up_b"]
    now, step = nodes.select(*NODE, F.col("pa").alias("up_a"), F.col("pb").alias("up_b"), "leaves", "saved"), 1
    most = nodes.agg(F.max("depth")).first()[0] or 0
    while step <= most:
        # Each node takes the sums of those `step` below it, then looks twice as far up.
        below = (now.filter("up_a IS NOT NULL").groupBy((F.col("depth") - step).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
                 .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
        above = now.select((F.col("depth") + step).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                           F.col("up_a").alias("far_a"), F.col("up_b").alias("far_b"))
        now = (now.join(below, NODE, "left").join(above, ["depth", *up], "left")
               .select(*NODE, F.col("far_a").alias("up_a"), F.col("far_b").alias("up_b"),
                       (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                       (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        now, step = written(now, "trie-sums"), 2 * step
    return now.select(*NODE, "leaves", "saved")


def trie(rows: DataFrame, segment: int = SEGMENT, tree_rows: int = TREE_ROWS) -> DataFrame:
    """The nodes of the trie over (conv, pos, id, words) as ``rebuild`` gives
    them: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)."""
    spark = rows.sparkSession
    keys = segments(rows, segment).select("layer", "sa", "sb", "key", "conv", F.coalesce("more", F.lit(False)).alias("more"), "words", "ma", "mb")
    order = ["layer", "sa", "sb", "key", "conv"]
    dealt = keys.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    parts = written(dealt.mapInArrow(_trees(segment, tree_rows), PARTS), "trie-parts")

    # Open nodes: parts summed, children counted, then sums over their subtrees.
    split = parts.filter(F.col("kind") == OPEN)
    whole = written(split.groupBy(*NODE).agg(
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("words").alias("words")), "trie-open")
    kids = (whole.filter("pa IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
            .agg(F.count("*").alias("kids")))
    whole = written(whole.join(kids, NODE, "left")
                    .withColumn("n_children", F.col("closed") + F.coalesce("kids", F.lit(0)))
                    .withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long"))
                    .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words")), "trie-whole")
    ends = parts.filter(F.col("kind") == ENDS)
    ends = (ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").select(*NODE, "text")
            .mapInArrow(_hash_ends, "depth long, a long, b long, ends string"))
    name = whole.select(F.col("depth").alias("d"), F.col("a").alias("na"), F.col("b").alias("nb"), F.col("conv_id").alias("name"))

    def parent(df: DataFrame, names: DataFrame, *extra: Column) -> DataFrame:
        on = (F.col("depth") - 1 == F.col("d")) & (F.col("pa") == F.col("na")) & (F.col("pb") == F.col("nb"))
        for e in extra:
            on = on & e
        return df.join(names, on, "left")

    opened = (parent(whole.drop("leaves", "saved").join(_subtree_sums(whole), NODE).join(ends, NODE, "left"), name)
              .select("conv_id", "depth", F.col("name").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")))
    # Closed nodes below an open one learn its name through their own tree's
    # part of it, so a parent with any number of children is dealt by tree.
    mine = (split.select("tree", *NODE).join(whole.select(*NODE, F.col("conv_id").alias("name")), NODE)
            .select(F.col("tree").alias("t"), F.col("depth").alias("d"), F.col("a").alias("na"), F.col("b").alias("nb"), "name"))
    shut = parts.filter(F.col("kind") == CLOSED)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("text").alias("ends_sha256")]
    tops = (parent(shut.filter("parent_open"), mine, F.col("tree") == F.col("t"))
            .withColumn("parent_conv_id", F.col("name")).select(*out))
    return opened.unionByName(shut.filter("NOT parent_open").select(*out)).unionByName(tops)


def conversation_trie(rows: DataFrame, **options) -> DataFrame:
    """The trie of the rebuilt conversations of a table of (conv_id, turn, role, text)."""
    return trie(rebuild(turns(rows)), **options)


SQL = r"""
WITH RECURSIVE bytes AS (SELECT DISTINCT conv_id AS c, CAST(CAST(conv_id AS VARCHAR) AS BLOB) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, s, 0 AS i, 4294967295::BIGINT AS v FROM bytes
        UNION ALL
        SELECT c, s, i + 1,
               CASE WHEN i % 9 = 0 THEN xor(v, ascii(substr(CAST(c AS VARCHAR), i // 9 + 1, 1))::BIGINT)
                    WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END
        FROM crc WHERE i < 9 * length(CAST(c AS VARCHAR))),
convs AS (SELECT c, xor(v, 4294967295::BIGINT) % 4 AS h, c - c % 20 AS base FROM crc WHERE i = 9 * length(CAST(c AS VARCHAR))),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
      FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT c, 0 AS own, k, role, text FROM convs JOIN t ON t.conv_id = base AND k <= h
      UNION ALL SELECT c, 1, k, role, text FROM convs JOIN t ON t.conv_id = c AND k > h),
p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d, sha256(length(role) || ':' || role || text) AS id,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
s AS (SELECT convs.c, coalesce(list(id ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS path FROM convs LEFT JOIN p ON convs.c = p.c GROUP BY convs.c),
m AS (SELECT c, len(path) AS len, d, path[1:d] AS node FROM s, unnest(range(len(path) + 1)) u(d)),
n AS (SELECT node, m.d AS depth, min(m.c) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words,
             sha256(coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (WHERE len = m.d), '')) AS ends_sha256
      FROM m LEFT JOIN p ON m.c = p.c AND m.d = p.d GROUP BY node, m.d),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.node = kids.node),
sub AS (SELECT f.node[1:d] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
        FROM f, unnest(range(depth + 1)) u(d) GROUP BY 1)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN sub ON f.node = sub.node LEFT JOIN n up ON f.depth > 0 AND up.node = f.node[1:f.depth - 1]
"""
