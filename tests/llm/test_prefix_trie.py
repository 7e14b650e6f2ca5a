"""op13: radix tree layouts, and the trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sf_paths import SF_MID
from txsentry.llm import prefix_trie as pt
from txsentry.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    seqs = {}
    for c in own:
        own[c].sort(key=lambda x: x[:2])
    for c in own:
        mine = [x[2:] for x in own[c]]
        h = zlib.crc32(str(c).encode()) % 4
        base = [x[2:] for x in own.get(c - int(c - 20 * int(c / 20)), [])]
        seqs[c] = (base[:h] + mine[h:]) if rebuild else mine
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        w = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * w + sum(saved[k] for k in kids[node])
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -999, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def told(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-999 if r[c] is None else r[c] for c in cols) for r in df.collect())


def rows_of(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_layouts():
    rng = random.Random(1)
    root, keys = pt.Node(b""), {bytes([rng.choice([7, k % 256]), k // 256, *rng.randbytes(2)]) for k in range(3000)}
    keys |= {bytes([9, k % 40, k % 251, 1]) for k in range(500)}
    for n, k in enumerate(sorted(keys)):
        pt.insert(root, k, n)
    assert root.layout == 256
    layouts, found, stack = set(), [], [(root, b"")]
    while stack:
        node, before = stack.pop()
        layouts.add(node.layout)
        path = before + node.path
        if node.value is not None:
            found.append((path, node.value))
        kids = list(node.children())
        assert len(kids) <= node.layout
        shown = [b for b in range(256) if node.child(b) is not None]
        assert [node.child(b) for b in shown] == kids
        stack += [(k, path + bytes([b])) for b, k in zip(shown, kids)]
    assert sorted(found) == [(k, n) for n, k in enumerate(sorted(keys))]
    assert layouts >= {4, 16, 48, 256}


def test_path_compression_and_prefix_keys():
    root = pt.Node(b"")
    for n, k in enumerate([b"abcdefgh", b"abcd", b"", b"abcdefzz", b"abcdx", b"q"]):
        pt.insert(root, k, n)
    assert root.value == 2
    a = root.child(ord("a"))
    assert a.path == b"bcd" and a.value == 1          # one node for four bytes
    assert a.child(ord("e")).path == b"f" and a.child(ord("x")).value == 4


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(op13_prefix_trie(spark, SF_MID)) == brute(rows)


def random_rows(seed, n=60, turns=9, words=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "x"]), " ".join("w" * rng.randint(1, 2) for _ in range(rng.randint(1, words))))
            for c in range(-n // 3, n) for t in range(rng.randint(0, turns))]


@pytest.mark.parametrize("segment,tree_rows", [(64, 1 << 14), (2, 5), (1, 1), (3, 2)])
def test_trees_and_layers(spark, segment, tree_rows):
    # shared paths over many trees, conversations over many layers
    rows = random_rows(segment)
    assert told(pt.conversation_trie(rows_of(spark, rows), segment=segment, tree_rows=tree_rows)) == brute(rows)


def test_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_IDS", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)]
    rows += [(c, t, "user", "same 0" if t == 0 else f"own {c} {t}") for c in range(300, 500) for t in range(4)]
    assert told(pt.conversation_trie(rows_of(spark, rows, 9), tree_rows=16)) == brute(rows)


def test_long_conversation(spark, monkeypatch):
    # one conversation holds most rows: numbered over all tasks, cut into layers
    monkeypatch.setattr(pt, "SUPER", 8)
    rows = [(3, t, "user", f"t{t % 5}") for t in range(3000)] + [(8, t, "user", f"t{t % 5}") for t in range(700)] + random_rows(4, 30)
    df = rows_of(spark, rows, 8)
    counted = pt.rebuild(pt.turns(df)).filter("conv = 3 AND pos IS NOT NULL").agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()
    assert counted[0] == 1 and counted[1] == counted[2] >= 2997
    assert told(pt.conversation_trie(df, tree_rows=64, segment=16)) == brute(rows)


def test_edges(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 0, "", ""), (1, 1, "a", "b"), (1, 1, "ab", ""), (1, 1, "a", "b"),
            (0, 5, "user", "x y z"), (0, 6, "user", " \t "), (20, 1, "user", "only"), (None, 1, "user", "nobody"), (21, 1, "user", "é " * 9000),
            (-3, 1, "user", "x y z"), (-20, 0, "s", "t"), (40, None, None, None)]
    df = rows_of(spark, rows).withColumns({"id": F.lit(1), "depth": F.lit("d"), "conv": F.lit(2.0), "pos": F.lit(None).cast("string")})
    assert told(pt.conversation_trie(df)) == brute(rows)
    assert told(pt.conversation_trie(rows_of(spark, [(7, 0, "user", "hello there")]))) == brute([(7, 0, "user", "hello there")])
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pt.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
