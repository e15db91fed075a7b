"""Near-duplicate classes against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from cartlens.llm import orderhash


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    r = random.Random(3)
    pairs, limits = [], []
    for _ in range(250):
        a = [r.randint(0, 5 if r.random() < 0.3 else 500) for _ in range(r.randint(0, 100))]
        b = list(a)
        for _ in range(r.randint(0, 25)):
            at, what = r.randint(0, len(b)), r.random()
            if what < 0.4 and at < len(b):
                b[at] = r.randint(0, 500)
            elif what < 0.7:
                b.insert(at, r.randint(0, 500))
            elif at < len(b):
                del b[at]
        pairs.append((np.array(a, "<u4"), np.array(b, "<u4")))
        limits.append(int(0.2 * max(len(a), len(b))))
    expected = [min(plain_distance(a.tolist(), b.tolist()), n + 1) for (a, b), n in zip(pairs, limits)]
    assert orderhash.alignment_distances(pairs, limits).tolist() == expected


def test_sketches_keep_the_order_and_label_occurrences():
    def of(*texts):
        return orderhash.sketches(*orderhash.word_hashes(pa.array(texts)))

    words = [f"w{i}" for i in range(60)]
    turned = words[30:] + words[:30]
    a, b, c = of(" ".join(words), " ".join(words).upper(), " ".join(turned))
    assert (a == b).all()
    # Halves in another order share nearly all runs, but not their order.
    assert 0 < (a == c).sum() < orderhash.SKETCHES
    once, twice = of("a b c d e", "a b c d e a b c d e")
    assert not (once == twice).all()
    assert (of("", None, " ") == 0).all()


def edited(words, n, seed):
    r = random.Random(seed)
    words = list(words)
    for k in range(n):
        words[r.randrange(len(words))] = f"new{seed}x{k}"
    return " ".join(words)


def brute(rows):
    texts = {i: [w.lower() for w in (t or "").split()] for i, t in rows}
    name = {i: i for i in texts}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(i for i in texts if texts[i])
    for x, a in enumerate(ids):
        for b in ids[:x]:
            m, n = len(texts[a]), len(texts[b])
            if min(m, n) >= 0.8 * max(m, n) and plain_distance(texts[a], texts[b]) <= int(0.2 * max(m, n) + 1e-9):
                p, q = sorted((top(a), top(b)))
                name[q] = p
    return {i: top(i) for i in texts}


def test_classes(documents_of, prose):
    rows = []
    for base in range(12):
        words = prose(80, base).split()
        rows.append((len(rows), " ".join(words)))
        for copy in range(base % 4):
            rows.append((len(rows), edited(words, 3 * copy, 100 * base + copy)))
    passage = prose(60, 99)
    rows += [(len(rows) + k, passage + " " + prose(90, 200 + k)) for k in range(6)]
    rows += [(200, "a b"), (201, "a  b"), (202, "a c"), (203, "one two three four five six"), (204, "one two three four five six")]
    rows += [(300, None), (301, ""), (302, "  ")]
    found = {r["doc_id"]: r["class_id"] for r in orderhash.classes(documents_of(rows), "doc_id", "text").collect()}
    assert found == brute(rows)


def test_large_groups_of_copies(documents_of, prose):
    words = prose(60, 1).split()
    rows = [(i, " ".join(words)) for i in range(400)] + [(400 + i, edited(words, 2, i)) for i in range(200)]
    rows += [(700, prose(60, 2))]
    found = orderhash.classes(documents_of(rows), "doc_id", "text").collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {i: 0 if i < 700 else i for i, _ in rows}
    assert [r["doc_id"] for r in found if r["kept"]] in ([0, 700], [700, 0])


def star(prose, copies, share, n=100):
    """A text and copies that are each near to it, but seldom to each other."""
    words = prose(n, 5).split()[:n]
    rows = [(0, " ".join(words))]
    for k in range(1, copies + 1):
        r, own = random.Random(k), list(words)
        for at in r.sample(range(n), r.randint(*share)):
            own[at] = f"own{k}x{at}"
        rows.append((k, " ".join(own)))
    return rows


def test_copies_joined_only_by_their_original(documents_of, prose, monkeypatch):
    monkeypatch.setattr(orderhash, "BLOCK", 64)
    # The original is not the first in the order of a sketch, and not next to most copies.
    rows = [(1000 if i == 0 else i, t) for i, t in star(prose, 500, (12, 15))]
    found = {r["doc_id"]: r["class_id"] for r in orderhash.classes(documents_of(rows), "doc_id", "text").collect()}
    hashes = orderhash.sketches(*orderhash.word_hashes(pa.array([t for _, t in rows])))
    meets = {i for (i, _), own in zip(rows, hashes, strict=True) if (own == hashes[0]).any()}
    assert len(meets) > 400
    assert {found[i] for i in meets} == {min(meets)}


def test_sketches_find_pairs_at_the_bound():
    r = random.Random(8)
    missed, n = [], 400
    for length, even in ((15, True), (40, True), (100, True), (100, False), (300, True)):
        texts = []
        for k in range(n):
            words = [f"w{r.randrange(10**6)}" for _ in range(length)]
            copy = list(words)
            for at in range(2, length, 5) if even else r.sample(range(length), length // 5):
                copy[at] = f"x{k}y{at}"
            texts += [" ".join(words), " ".join(copy)]
        found = orderhash.sketches(*orderhash.word_hashes(pa.array(texts)))
        missed.append(int((~(found[::2] == found[1::2]).any(axis=1)).sum()))
    assert sum(missed) <= 0.01 * 5 * n, missed


def test_short_texts(documents_of):
    r = random.Random(4)
    rows = []
    for k in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(4 + k % 11)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(int(0.2 * len(words)) or 1):
            at, what = r.randrange(len(words)), r.random()
            if what < 0.5:
                words[at] = f"new{k}"
            elif what < 0.75:
                words.insert(at, f"more{k}")
            else:
                del words[at]
        rows.append((len(rows), " ".join(words)))
    # One word that stands in every run of five.
    rows += [(400, "a b c d e f g h i"), (401, "a b c d z f g h i"), (402, "k l m n"), (403, "k l m n o"), (404, "k l m")]
    found = {r["doc_id"]: r["class_id"] for r in orderhash.classes(documents_of(rows), "doc_id", "text").collect()}
    assert found == brute(rows)


def test_odd_rows(odd, empty):
    found = orderhash.classes(odd, "doc_id", "text").collect()
    assert len(found) == odd.count()
    classes = {}
    for r in found:
        classes.setdefault(r["doc_id"], set()).add((r["class_id"], r["kept"]))
    assert classes[None] == {(None, True)}
    assert classes[10] == {(10, True)} and classes[11] == {(10, False)}
    assert all(classes[i] == {(i, True)} for i in range(9))
    assert orderhash.classes(empty, "doc_id", "text").collect() == []


def changed(r, words, edits, letters):
    words = list(words)
    for _ in range(edits):
        at = r.randrange(len(words) + 1)
        kind = r.randrange(3)
        if kind == 0:
            words.insert(at, r.choice(letters))
        elif at < len(words):
            words[at : at + 1] = [] if kind == 1 else [r.choice(letters)]
    return words


def test_bands_of_bits_are_exact(monkeypatch):
    """Distances up to the reach, for lists that are longer than one stretch of columns, too."""
    monkeypatch.setattr(orderhash, "BAND", 32)
    r = random.Random(3)
    for _ in range(1500):
        letters = range(r.choice([2, 5, 500]))
        a = r.choices(letters, k=r.randint(1, 45))
        b = changed(r, a, r.randint(0, 14), letters) or [0]
        a, b = sorted((a, b), key=len)
        true = plain_distance(a, b)
        for reach in {len(b) - len(a), len(b) - len(a) + 3, 50}:
            assert orderhash._in_band(np.array(a), np.array(b), reach) == min(true, reach + 1)


def test_counts_of_runs_never_rule_out_a_link():
    r = random.Random(4)
    for _ in range(400):
        letters = [f"w{i}" for i in range(r.choice([1, 3, 40, 3000]))]
        a = r.choices(letters, k=r.choice([1, 2, 7, 30, 300, 600, 1300]))
        b = changed(r, a, int(0.2 * len(a)), letters) or ["x"]
        hashes, places = orderhash.word_hashes(pa.array([" ".join(a), " ".join(b)]))
        limit = int(orderhash._limits(max(len(a), len(b))))
        if orderhash.alignment_distances([tuple(hashes[x:y] for x, y in zip(places, places[1:]))], [limit])[0] <= limit:
            assert orderhash._possible_pair(*orderhash.run_bags(hashes, places), len(a), len(b))
    # Texts of the same words in another order have few runs in common.
    a = [f"w{i}" for i in range(200)]
    hashes, places = orderhash.word_hashes(pa.array([" ".join(a), " ".join(r.sample(a, 200))]))
    assert not orderhash._possible_pair(*orderhash.run_bags(hashes, places), 200, 200)


def test_no_table_of_words_is_kept(documents_of, prose, monkeypatch):
    """Words are made where they are needed, and sketches go once they are sorted."""
    from cartlens.llm.storage import drop, kept

    standing, seen = {}, []
    monkeypatch.setattr(orderhash, "kept", lambda df, what: standing.setdefault((kept_ := kept(df, what)).inputFiles()[0].rsplit("/", 1)[0], (what, kept_.columns)) and (seen.append((what, kept_.columns, [w for w, _ in standing.values()])), kept_)[1])
    monkeypatch.setattr(orderhash, "drop", lambda *frames: [standing.pop(f.inputFiles()[0].rsplit("/", 1)[0]) for f in frames] and drop(*frames))
    rows = [(k, prose(60, k % 12)) for k in range(30)]
    assert orderhash.classes(documents_of(rows), "doc_id", "text").where("kept").count() == 12
    assert not any("words" in columns for _, columns, _ in seen)
    assert "sketches" not in next(there for what, _, there in seen if what == "candidates")
