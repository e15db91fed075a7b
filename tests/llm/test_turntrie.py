"""The trie of turns against plain dictionaries of prefixes."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from cartlens.llm import turntrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, key string, id int"


def plain(rows, group=5, heads=9):
    """The nodes as (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + mine[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in sorted(built.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        mine = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = mine + sum(saved[c] for c in children[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p),
        )
        for p, m in members.items()
    )


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, "k", 1) for r in rows], SCHEMA)


def trie(frame):
    keys = turntrie.conversation_keys(frame, "conv_id", "turn", "role", "text")
    return turntrie.trie(turntrie.rebuilt(keys, 5, 9))


def found(frame):
    rows = trie(frame).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted(map(tuple, rows.collect()))


def random_rows(seed, n, turns, words, long=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        length = r.randint(1, turns) if c or not long else long
        # A third of all conversations are one and the same.
        same = r.random() < 1 / 3
        for t in range(3 if same else length):
            text = f"hot {t}" if same else r.choice(words)
            rows.append((c * 3 - 20, t, "user" if t % 2 == 0 else "assistant", text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("run_rows", [1, 2, 7, 20_000])
def test_like_plain(spark, monkeypatch, run_rows):
    monkeypatch.setattr(turntrie, "RUN_ROWS", run_rows)
    rows = random_rows(run_rows, 150, 6, ["a", "b", "é", "", "longer text"])
    assert found(conversations(spark, rows)) == plain(rows)


def test_long_conversations_and_wide_nodes(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "RUN_BYTES", 2_000)
    rows = random_rows(1, 400, 3, [f"w{i}" for i in range(300)], long=900)
    assert found(conversations(spark, rows)) == plain(rows)


def test_node_layouts():
    """Nodes grow from 4 to 256 places, and paths are cut where keys part."""
    tree = turntrie.Tree()
    kinds = set()
    keys = sorted({bytes([a, b]) + bytes(14) + bytes([a]) * 16 for a in range(0, 256, 3) for b in range(a % 7 + 1)})
    random.Random(1).shuffle(keys)
    for k, key in enumerate(keys):
        tree.insert(key, k, [1, 1])
        kinds.add(type(tree.root).__name__)
    assert kinds == {"Node4", "Node16", "Node48", "Node256"}
    read, todo = {}, [(tree.root, b"")]
    while todo:
        node, above = todo.pop()
        assert len([*node.ordered()]) != 1 or node.ends or node is tree.root
        for c in node.ends:
            read[above + node.path] = c
        todo += [(child, above + node.path) for byte, child in node.ordered()]
    assert read == {key: k for k, key in enumerate(keys)}


def test_cases(spark):
    rows = [
        (None, 1, "user", "no conversation"),
        (1, None, "user", "first"),
        (1, 0, None, "second"),
        (1, 0, None, None),
        (1, 0, None, None),
        (2, 5, "user", "x" * 50_000),
        (2, 5, "assistant", "x" * 50_000),
        (5, 1, "", ""),
        (7, 1, "ab", "c"),
        (8, 1, "a", "bc"),
        (-3, 1, "user", "first"),
    ]
    frame = conversations(spark, rows)
    assert found(frame) == plain(rows)
    assert trie(frame.where("false")).count() == 0
    assert trie(frame).columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
