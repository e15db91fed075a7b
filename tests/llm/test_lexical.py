"""Ranked search against a plain scoring of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cartlens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(documents, items, k=50):
    held = [(doc, Counter(terms_of(text)), len(terms_of(text))) for doc, text in documents]
    held = [x for x in held if x[2]]
    n_docs, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, counts, _ in held for t in counts)
    found = []
    for item, text in items:
        asked = set(terms_of(text))
        scores = []
        for doc, counts, n in held:
            m = 50 + 50 * n * n_docs // total
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
                for t in asked & counts.keys()
            )
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc, s))
        found += [(item, rank + 1, x[3], x[4]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(found, key=str)


def searched(spark, documents, items, documents_of, **options):
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    found = lexical.search(documents_of(documents), "doc_id", "text", asked, "item_id", "text", **options)
    return sorted(map(tuple, found.collect()), key=str)


def corpus(n, seed, vocabulary=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(r.choices(words, weights, k=r.randint(0, 40)))) for i in range(n)]


def asked_for(seed, n=12, vocabulary=60):
    r = random.Random(seed)
    return [(i, " ".join(r.choices([f"W{i}" for i in range(vocabulary)], k=r.randint(1, 12)))) for i in range(n)]


@pytest.mark.parametrize("k", [3, 50])
def test_like_plain(spark, documents_of, k):
    documents, items = corpus(900, 1), asked_for(2)
    assert searched(spark, documents, items, documents_of, k=k) == plain(documents, items, k)


def test_many_shards_and_ranges(documents_of, monkeypatch):
    """One index cut into many ranges, with every way to tell short lists from long ones, gives what one range gives."""
    documents = [(i, Counter(terms_of(t))) for i, t in corpus(3000, 3)]
    documents = [x for x in documents if x[1]]
    names = sorted({t for _, c in documents for t in c})
    number = {t: i for i, t in enumerate(names)}
    n = np.array([sum(c.values()) for _, c in documents])
    rows = [(d, number[t], x) for d, (_, c) in enumerate(documents) for t, x in sorted(c.items())]
    doc, term, count = map(np.array, zip(*rows))
    weight = lexical.weights(np.bincount(term), len(n))
    total = int(n.sum())
    norm = 50 + 50 * n * len(n) // total
    gives = weight[term] * (10**9 * count // (1000 * count + 20 * norm[doc]))
    r = random.Random(4)
    for size, share in ((64, 0), (64, 1), (64, 0.1), (4096, 0.1)):
        monkeypatch.setattr(lexical, "RANGE", size)
        monkeypatch.setattr(lexical, "SHORT", share)
        shard = lexical.Shard(n, doc, term, count, weight, len(n), total)
        if not share:
            shard.short = 0
        for _ in range(15):
            asked = np.array(sorted(r.sample(range(len(names)), r.randint(1, 20))))
            best = lexical.Best(10)
            shard.search(asked, best.least, lambda docs, score: best.add(score, docs, np.zeros(len(docs), bool)))
            inside = np.isin(term, asked)
            scores = np.zeros(len(n), np.int64)
            np.add.at(scores, doc[inside], gives[inside])
            order = np.lexsort((np.arange(len(n)), -scores))[:10]
            assert best.ids.tolist() == order[scores[order] > 0].tolist()
            assert best.score.tolist() == scores[order][scores[order] > 0].tolist()


def test_blocks_of_items(spark, documents_of, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    documents, items = corpus(200, 5), asked_for(6)
    assert searched(spark, documents, items, documents_of) == plain(documents, items)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"T{i % 37}-{'x' * (i % 50)}" for i in range(2000)) + "y" * 3000
    data = np.frombuffer(text.encode(), np.uint8)
    known = lexical.Vocabulary([0], [np.unique(lexical.term_hashes(data, np.array([0, len(data)]))[0])])
    whole = known.counts(data, np.array([0, len(data)]))
    monkeypatch.setattr(lexical, "CHUNK", 1000)
    for a, b in zip(whole, known.long_counts(data)):
        assert a.tolist() == b.tolist()


def test_cases(spark, documents_of, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    # The item of only separators and the null one have no result; equal items have one each; ties go to the smaller id, null last.
    items = [(1, "same text"), (1, "same text"), (2, None), (3, "-- ,"), (None, "日本語のテキスト row"), (5, "a id X" + "x" * 19_999)]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    found = lexical.search(odd, "doc_id", "text", asked, "item_id", "text")
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, items)
    assert lexical.search(empty, "doc_id", "text", asked, "item_id", "text").count() == 0
    assert lexical.search(odd, "doc_id", "text", asked.where("false"), "item_id", "text").count() == 0
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_session_is_as_before(spark, documents_of):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    searched(spark, corpus(20, 7), asked_for(8, 2), documents_of)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
