"""The mix of sources against exact fractions and a plain walk through every source."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from cartlens.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, part int, number bigint, size string"


def plain(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for _, _, s in rows) else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    own = Counter()
    for n, (_, _, s) in zip(size, rows):
        own[s] += n
    total, stopped = sum(size), set()
    while True:
        rest = total - sum(3 * own[s] for s in stopped)
        units = sum(weight[s] for s in sources if s not in stopped)
        more = {s for s in sources if s not in stopped and Fraction(rest * weight[s], units) > 3 * own[s]}
        if not more:
            break
        stopped |= more
    target = {s: Fraction(3 * own[s]) if s in stopped else Fraction(rest * weight[s], units) for s in sources}
    key = lambda i, t: hashlib.md5(f"mix:{i if i is not None else 'text:' + (t or '')}".encode()).hexdigest()
    found = []
    for s in sources:
        docs = sorted((key(i, t), i or 0, n, i) for (i, t, x), n in zip(rows, size) if x == s)
        budget = int(target[s] + Fraction(1, 2))
        at = 0
        for _, _, n, i in docs:
            whole, rest = divmod(budget, own[s]) if own[s] else (0, 0)
            found.append((i, n, own[s], float(target[s]), whole * n + max(0, min(n, rest - at))))
            at += n
    return found


def mixed(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in rows], SCHEMA)
    return mixing.mix(frame, "doc_id", "text", "source", **options)


def close(found, expected):
    found, expected = sorted(found, key=str), sorted(expected, key=str)
    assert [(r[0], r[1], r[2], r[4]) for r in found] == [(r[0], r[1], r[2], r[4]) for r in expected]
    assert all(abs(a[3] - b[3]) <= 1e-9 * max(1, b[3]) for a, b in zip(found, expected))


def corpus(seed, n, sources):
    r = random.Random(seed)
    # A third of the rows are of one source.
    return [(i, " ".join(["w"] * r.randint(0, 30)), sources[0] if r.random() < 1 / 3 else r.choice(sources)) for i in range(n)]


def test_like_plain(spark):
    for seed, sources in ((1, ["b", "a", "é", "z", None]), (2, [f"s{i}" for i in range(40)]), (3, ["only"])):
        rows = corpus(seed, 600, sources)
        found = mixed(spark, rows).select("doc_id", "size", "source_size", "target", "taken").collect()
        close(map(tuple, found), plain(rows))


def test_budgets_are_met(spark):
    rows = corpus(4, 500, ["big", "big", "big", "big", "tiny", "small"])
    found = mixed(spark, rows).collect()
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["whole"] * r["size"] + r["part"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    # A source of few words stops at three epochs of it.
    assert max(r["whole"] for r in found) == 3


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(5, 400, ["a", "b", "c"]) + [(None, "the same", "a")] * 30 + [(7, "the same", "a")] * 5
    one = sorted(map(tuple, mixed(spark, rows).collect()), key=str)
    random.Random(1).shuffle(rows)
    again = sorted(map(tuple, mixed(spark, rows).collect()), key=str)
    assert one == again


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", None), (None, "one two", None), (None, "one two", None), (4, "x" * 100_000, "c"), (4, "y z", "c")]
    found = mixed(spark, rows).select("doc_id", "size", "source_size", "target", "taken").collect()
    close(map(tuple, found), plain(rows))
    assert mixed(spark, []).count() == 0
    none = mixed(spark, [(1, None, "a"), (2, " ", None)]).select("size", "target", "taken").collect()
    assert [tuple(r) for r in none] == [(0, 0.0, 0), (0, 0.0, 0)]
