"""Secrets and personal data against plain regular expressions."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from cartlens.llm import credentials, pii, queries

SECRET_RULES = [
    (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def n_digits(text):
    return sum(c.isdigit() for c in text)


PII_RULES = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= n_digits(m[0]) <= 19 and luhn(m[0])),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= n_digits(m[0]) <= 15),
]


def plain(text, rules):
    return sorted((m.start(), k, m.end()) for k, (rule, good) in enumerate(rules) for m in rule.finditer(text or "") if good(m))


def check(rows, texts, rules, kinds):
    assert len(rows) == len(texts)
    by_id = dict(texts)
    for row in rows:
        spans = plain(by_id[row["doc_id"]], rules)
        said = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), by_id[row["doc_id"]][:200]
        for k, kind in enumerate(kinds):
            assert row[f"n_{kind}"] == sum(s[1] == k for s in spans)
        assert [s for s in row["spans"].split(",") if s.split(":")[0] in kinds] == [s for s in said.split(",") if s]


def fuzz(letters, seed, n=600):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(0, 50))) for _ in range(n)]


def test_base_secrets(documents_of, odd, empty):
    letters = [*"ab09=: '\"_.-é", "password", "TOKEN", "api_key", "apikey", "Secret", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "ſecret", "Key"]
    texts = list(enumerate(fuzz(letters, 2) + [t for t in ("token=" * 2000, "deadbeef" * 4000)]))
    documents = documents_of(texts)
    found = queries.span_digests(credentials.spans(documents, "doc_id", "text"), credentials.BASE).collect()
    check(found, texts, SECRET_RULES, credentials.BASE)
    rows = credentials.spans(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count()
    assert credentials.spans(empty, "doc_id", "text").collect() == []


def kinds_of(text):
    return [credentials.KINDS[k] for _, k, _ in sorted(credentials.linked_spans(text, credentials.base_spans(text)))]


def test_weak_parts_need_complements():
    secret, name, place = "aB3dE5gH7jK9lM1nP3qR5", "client_id = portal-7712", "https://api.example.com/v1"
    assert kinds_of(f"{name}\nvalue {secret}\nat {place}") == ["weak_id", "weak_secret", "endpoint"]
    assert kinds_of(name) == kinds_of(secret) == kinds_of(place) == []
    assert kinds_of(f"{place} {name}") == kinds_of(f"{place} {secret}") == []
    assert kinds_of(f"{name}\n{secret}") == ["weak_id", "weak_secret"]
    # A strong part complements a weak one; a blank line or a long way separates scopes.
    assert kinds_of(f"AKIAABCDEFGHIJKLMN {secret}") == ["weak_secret"]
    assert kinds_of(f"{name}\n\n{secret}") == []
    assert kinds_of(name + " word" * 100 + f" {secret}") == []


def test_interval_join_agrees_with_all_pairs():
    r = random.Random(4)
    for _ in range(200):
        make = lambda: sorted((a, 3, a + r.randint(1, 20)) for a in r.sample(range(3000), r.randint(0, 8)))
        one, two, scopes = make(), make(), sorted(r.sample(range(3000), 3))
        scope = lambda s: sum(x <= s[0] for x in scopes)
        bounds = [0, *scopes, 10**9]
        expected = []
        for s in one:
            low, high = max(s[0] - credentials.REACH, bounds[scope(s)]), min(s[2] + credentials.REACH, bounds[scope(s) + 1])
            expected.append(any(o[0] >= s[2] and o[0] < high or o[2] <= s[0] and o[2] > low for o in two))
        assert credentials._beside(one, two, scopes) == expected


def test_base_personal_data(documents_of, odd, empty):
    letters = [*"0123456789..--++@@  ()a_%é🙂", "1.2.3.4", "4539578763621486", "+1 (988) 555-2485", "a@b.cd", ".5", "255.0.0.256"]
    texts = list(enumerate(fuzz(letters, 5) + ["1 " * 9000, "+1" + "(" * 9000, "1.2." * 4000]))
    found = pii.spans(documents_of(texts), "text", ["doc_id", "spans"])
    digests = queries.span_digests(found.selectExpr("carried.doc_id as id", "spans"), pii.BASE).collect()
    check(digests, texts, PII_RULES, pii.BASE)
    assert pii.spans(odd, "text", odd.columns).count() == odd.count()
    assert pii.spans(empty, "text", empty.columns).collect() == []


def test_contexts_find_further_identifiers(documents_of):
    seeds = [(i, f"x please call me +1 (988) 555-{i:04d} ok") for i in range(30)]
    unseen = [(100 + i, f"y call me 555-98{i}23 now") for i in range(5)]
    mixed = [(200 + i, f"the {i}98765 of +1 (988) 555-{i:04d} or the a{i}@b.cd") for i in range(10)]
    documents = documents_of([*seeds, *unseen, *mixed, (300, "clean text of words, 1234 x")])
    rows = {r["carried"]["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.spans(documents, "text", ["doc_id"]).collect()}
    assert all(rows[100 + i] == [("found_phone", 10, 19)] for i in range(5))
    assert not any(k.startswith("found") for i in range(10) for k, *_ in rows[200 + i])
    assert rows[300] == []


def found_in(documents):
    rows = pii.spans(documents, "text", ["doc_id", "text"]).collect()
    return {r["carried"]["doc_id"]: [(s["kind"], r["carried"]["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in rows}


def test_grouped_and_spelled_identifiers_are_found(documents_of):
    seeds = [(i, f"x please call me +1 (988) 555-{i:04d} ok") for i in range(30)]
    seeds += [(50 + i, f"or write to mail john{i}@example{i}.com today") for i in range(30)]
    unseen = {
        100: ("so call me (988) 555-0123 now", [("found_phone", "(988) 555-0123")]),
        101: ("so call me 020 7946 0958", [("found_phone", "020 7946 0958")]),
        102: ("so call me 98 85 55 01 23.", [("found_phone", "98 85 55 01 23")]),
        103: ("then write to mail john[at]example[dot]com", [("found_email", "john[at]example[dot]com")]),
        104: ("then to mail jane (at) example.org or else", [("found_email", "jane (at) example.org")]),
        105: ("then to mail Jane At example Dot co dot uk", [("found_email", "Jane At example Dot co dot uk")]),
        # Two in a row; and the context is far from the match before it.
        106: ("call me 555-98123 or call me 555-98124", [("found_phone", "555-98123"), ("found_phone", "555-98124")]),
        107: ("call me 555-98125 " + "word " * 60 + "call me" + " " * 100 + "555-98126", [("found_phone", "555-98125"), ("found_phone", "555-98126")]),
        # Digits are no address, an address is no number, and ordinary words are neither.
        108: ("write to mail 020 7946 0958 and call me john[at]example[dot]com", []),
        109: ("we met at the house and look at example. Then 1 2 3", []),
    }
    documents = documents_of([*seeds, *((k, text) for k, (text, _) in unseen.items())])
    found = found_in(documents)
    assert {k: found[k] for k in unseen} == {k: spans for k, (_, spans) in unseen.items()}


def test_long_runs_are_looked_at_once(documents_of):
    """Texts that would make a pattern start again and again."""
    texts = ["1 " * 60_000, "1-" * 60_000 + "a", "a" * 120_000 + " at ", "a.b " * 40_000, "(" * 100_000, "at dot " * 30_000]
    assert pii.spans(documents_of(list(enumerate(texts))), "text", ["doc_id"]).count() == len(texts)


def plain_patterns(occurrences):
    """pattern -> (kind, precision), by dictionaries."""
    edges = {}
    for pattern, value, kind, shape in occurrences:
        kinds, can = edges.setdefault((pattern, value), (set(), set()))
        kinds |= {kind} - {None}
        can |= set(pii.SHAPES.get(shape, ()))
    heard = {edge: {k: float(k in kinds) for k in pii.BASE} for edge, (kinds, _) in edges.items() if kinds}
    for _ in range(pii.ROUNDS):
        precision, support = {}, {}
        for pattern in {p for p, _ in edges}:
            # In the first round all instances count, the unseen ones with nothing.
            own = [(e, c) for e, c in ({e: dict.fromkeys(pii.BASE, 0.0) for e in edges} | heard).items() if e[0] == pattern]
            precision[pattern] = {k: sum(c[k] for _, c in own) / len(own) for k in pii.BASE}
            support[pattern] = {k: sum(k in edges[e][0] for e, _ in own) for k in pii.BASE}
        for (pattern, value), (kinds, can) in edges.items():
            if not kinds:
                others = [p for p, v in edges if v == value and p != pattern and not edges[p, v][0]]
                heard[pattern, value] = {k: sum(precision[p][k] for p in others) / len(others) if others and k in can else 0.0 for k in pii.BASE}
    trusted = {}
    for pattern in precision:
        good = [(precision[pattern][k], support[pattern][k], -i, k) for i, k in enumerate(pii.BASE) if precision[pattern][k] >= pii.PRECISION and support[pattern][k] >= pii.SUPPORT]
        if good:
            trusted[pattern] = (max(good)[3], max(good)[0])
    return trusted


def test_scores_of_the_graph_like_plain_dictionaries(spark):
    r = random.Random(9)
    rows = []
    for _ in range(2500):
        pattern = f"p{int(r.triangular(0, 40, 3))}"
        if r.random() < 0.7:
            kind = ("phone" if pattern < "p2" else "email") if r.random() < 0.93 else r.choice(pii.BASE)
            rows.append((pattern, f"{kind}{r.randint(0, 300)}", kind, None))
        else:
            rows.append((pattern, f"c{r.randint(0, 80)}", None, r.choice(list(pii.SHAPES))))
    frame = spark.createDataFrame(rows, "pattern string, value string, kind string, shape string")
    found = {r["pattern"]: (r["kind"], r["precision"]) for r in pii.trusted_patterns(frame).collect()}
    expected = plain_patterns(rows)
    assert 3 < len(expected) < 41 and found.keys() == expected.keys()
    for pattern, (kind, precision) in expected.items():
        assert found[pattern][0] == kind and found[pattern][1] == pytest.approx(precision)


def test_redaction(spark):
    rows = spark.createDataFrame(
        [("é a@b.cd and 1.2.3.4!", [("email", 2, 8), ("ip", 13, 20)]), ("abcdef", [("card", 0, 4), ("phone", 2, 5)]), (None, []), ("", [])],
        f"text string, spans array<{pii.SPAN}>",
    )
    found = [r[0] for r in rows.select(pii.redacted("text", "spans")).collect()]
    assert found == ["é [EMAIL] and [IP]!", "[CARD]f", None, ""]


@pytest.mark.parametrize("size", [20, 200, 201, 5000])
def test_long_secret_beside_an_identifier(size):
    r = random.Random(size)
    token = "aB3" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=size - 3))
    text = f"https://example.com/login client_id=abcdef12 {token}"
    found = credentials.linked_spans(text, credentials.base_spans(text))
    start = text.index(token)
    assert (start, credentials.KINDS.index("weak_secret"), start + size) in found
    assert {credentials.KINDS[k] for _, k, _ in found} == {"weak_id", "weak_secret", "endpoint"}
