"""Encoding against the tokenizers library, and packing as an exact round trip."""

from __future__ import annotations

import time
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cartlens.llm import bpe, packing, queries, text


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, encoding="utf-8") as file:
        return bpe.Encoder(bpe.Vocabulary(file.read()))


def ids_of(encoder, texts):
    ids, places = encoder.encode(*text.utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:])]


def test_random_texts_encode_as_the_library_does(encoder, library):
    r = random.Random(1)
    letters = [*"abstrevlmd'''   \n\t.,!?0129éñ日本½²Ⅷ　\xa0🙂_-<|>", "<|endoftext|>", " 's", "'re", "'ll", "'S", "\x1c", "\x85"]
    for _ in range(300):
        texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(8)] + [None, ""]
        expected = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert ids_of(encoder, texts) == expected


def test_forgetting_words_changes_nothing(encoder, library, monkeypatch, prose):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    texts = [prose(60, seed) for seed in range(4)]
    for t in texts:
        assert ids_of(encoder, [t]) == [library.encode(t, add_special_tokens=False).ids]


def test_digests(odd, library):
    found = bpe.digests(odd, "doc_id", "text").collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expected = []
    for doc, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((doc, len(ids), sha(",".join(map(str, ids))), sha(back)))
    key = lambda r: (r[0] is None, *r[1:])
    assert sorted((tuple(r) for r in found), key=key) == sorted(expected, key=key)


def test_encode_texts_gives_ids_and_texts(odd):
    for row in bpe.encode_texts(odd, "doc_id", "text").collect():
        assert isinstance(row["ids"], list) and isinstance(row["decoded"], str)


def whole(pieces, documents, library):
    """Check that the pieces are the documents and that sequences are full; returns lengths of sequences."""
    expected = {}
    for r in documents.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        expected.setdefault(r["doc_id"], []).append(np.array(ids, "<u4"))
    sequences, starts = {}, {}
    for p in pieces:
        assert any(
            len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
            for x in expected[p["doc_id"]]
        )
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        starts.setdefault(p["doc_id"], 0)
        starts[p["doc_id"]] += p["length"]
    assert starts == {k: sum(map(len, v)) for k, v in expected.items()}
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        lengths.append(at)
    return lengths


def test_packing_is_exact_and_has_no_padding(odd, empty, documents_of, prose, library):
    many = documents_of([(i, prose(40 + 60 * (i % 7), i)) for i in range(120)] + [(500 + i, prose(30, 3)) for i in range(40)])
    for documents in (odd, many):
        lengths = whole(queries.packed(documents).collect(), documents, library)
        assert all(n == packing.WINDOW or n & (n - 1) == 0 and n < packing.WINDOW for n in lengths)
    assert queries.packed(empty).collect() == []


def test_small_shards(documents_of, prose, library, monkeypatch):
    documents = documents_of([(i, prose(100, i)) for i in range(30)])
    ids = [np.array(library.encode(r["text"]).ids, "<u2") for r in documents.collect()]
    found, n = packing.pack_shard(list(range(30)), ids, 7)
    assert found.num_rows >= 30 and set(found.column("sequence_id").to_pylist()) == set(range(7, 7 + n))


def test_small_pieces_are_gathered(spark, documents_of, prose, library):
    """A session that cuts exchanges into tiny pieces gets no more tasks than shuffle partitions, and a group of copies still is cut."""
    documents = documents_of([(i, prose(60, i)) for i in range(600)] + [(1000 + i, prose(60, 7)) for i in range(600)]).repartition(8).cache()
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        pieces = queries.packed(documents).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    whole(pieces, documents, library)
    tasks = {p["sequence_id"] >> 36 for p in pieces}
    assert len(tasks) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = [p["sequence_id"] >> 36 for p in pieces if p["doc_id"] >= 1000]
    assert len(set(copies)) >= 4
    documents.unpersist()


def test_sizes_of_settings():
    assert [packing.size_of(x) for x in ("16k", "64MB", "67108864b", " 8m ", "1000", "2GiB")] == [
        16 << 10, 64 << 20, 64 << 20, 8 << 20, 1000, 2 << 30
    ]


def test_pieces_leave_a_shard_in_bounded_batches():
    ids = [np.arange(100 + k % 50) for k in range(2_500)]
    found, _ = packing.pack_shard(list(range(2_500)), ids, 0)
    batches = list(packing.parts(found))
    assert len(batches) > 2 and max(b.num_rows for b in batches) <= 1000
    assert pa.Table.from_batches(batches).combine_chunks().equals(pa.Table.from_batches([found]).combine_chunks())


def test_packing_makes_no_tables_for_the_trie():
    with open(bpe.VOCABULARY, encoding="utf-8") as file:
        known = packing._encoder(file.read())
    known.encode(*text.utf8(pa.array(["words to be merged"])))
    assert not {"merges", "backwards"} & set(vars(known.vocabulary))


def test_neighbours_follow_their_seed():
    """Two topics: a window is filled from the topic of its seed as long as there is some."""
    r = np.random.default_rng(0)
    topics = [np.arange(100, 160), np.arange(5000, 5060)]
    ids = [r.choice(topics[k % 2], 300) for k in range(20)]
    shard = packing.Shard(np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids])))
    order = shard.order()
    assert sorted(order) == list(range(20))
    changes = sum(a % 2 != b % 2 for a, b in zip(order, order[1:]))
    assert changes == 1


def test_scores_are_bm25():
    ids = [np.array(x) for x in ([1, 1, 2, 9], [1, 3, 3], [2, 2, 2, 4, 5], [7])]
    places = np.append(0, np.cumsum([len(x) for x in ids]))
    shard = packing.Shard(np.concatenate(ids), places)
    mean = np.mean([len(x) for x in ids])
    found = np.zeros(len(ids))
    docs, scores = shard.scores(0)
    found[docs] = scores
    for d, x in enumerate(ids):
        score = 0.0
        for t in set(ids[0].tolist()):
            held = sum(t in y for y in ids)
            tf = int((x == t).sum())
            idf = np.log1p((len(ids) - held + 0.5) / (held + 0.5))
            score += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
        assert np.isclose(found[d], score)


def plain_order(shard, n):
    """Seeds and neighbours, each picked from all documents anew."""
    free, found, filled = set(range(1, n)), [0], int(shard.sizes[0]) + 1
    while free:
        shard.free[:] = [d in free for d in range(n)]
        scores, room = dict(zip(*(x.tolist() for x in shard.scores(found[-1])))), packing.WINDOW - filled % packing.WINDOW
        while room > 0 and free:
            best = max(free, key=lambda d: (scores.get(d, 0.0), -d))
            free.remove(best)
            found.append(best)
            filled += int(shard.sizes[best]) + 1
            room -= int(shard.sizes[best]) + 1
    return found


def test_order_is_greedy():
    r = np.random.default_rng(3)
    ids = [r.integers(1, 400, r.integers(0, 300)) for _ in range(150)] + [np.zeros(0, np.int64)] * 40 + [np.arange(50)] * 5
    places = np.append(0, np.cumsum([len(x) for x in ids]))
    expected = plain_order(packing.Shard(np.concatenate(ids), places), len(ids))
    assert packing.Shard(np.concatenate(ids), places).order() == expected


def test_a_shard_of_empty_texts_takes_seconds():
    n = 1_000_000
    shard = packing.Shard(np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
    began = time.time()
    assert shard.order() == list(range(n))
    assert time.time() - began < 60
