"""Archives as an exact round trip."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from cartlens.llm import queries, warc
from cartlens.llm.storage import new_folder

SCHEMA = "page_id bigint, url string, html string, payload string, capture_id int"
PAGES = [
    (1, "http://a.example/", "<p>same</p>"),
    (2, "http://b.example/", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (3, "http://c.example/x\r\nWARC-Type: fake", None),
    (4, "http://d.example/", ""),
    (None, "u", "<p>same</p>"),
    (5, "ü", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "x", "é\x00\r\n\r\n🙂" * 5000),
    (7, "x", "one"),
    (7, "x", "one"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows):
    ids = defaultdict(list)
    for page, _, html in rows:
        if page is not None:
            ids[html or ""].append(page)
    found = Counter()
    for page, _, html in rows:
        payload = (html or "").encode()
        last = max(ids[html or ""], default=None)
        refers = last if page is not None and page < last else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        found[page, len(payload), digest, "response" if refers is None else "revisit", refers] += 1
    return found


def test_round_trip(spark, monkeypatch):
    frame = pages(spark, PAGES)
    monkeypatch.setattr(queries, "_table", lambda *_: frame)
    assert Counter(map(tuple, queries.op8_warc_transactions(spark, "")  .collect())) == expected(PAGES)
    monkeypatch.setattr(queries, "_table", lambda *_: pages(spark, []))
    assert queries.op8_warc_transactions(spark, "").collect() == []


def test_captures_hold_whole_payloads(spark):
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.with_types(pages(spark, PAGES)), folder)
    found = warc.captures(warc.read_records(spark, folder)).collect()
    assert len(found) == len(PAGES)
    by_id = {p: (h or "").encode() for p, _, h in PAGES}
    for row in found:
        assert row["request"]["type"] == "request" and row["metadata"]["fields"] is not None
        page = row["metadata"]["fields"].get("captureId")
        if row["response"]["type"] == "response":
            assert row["response"]["intact"] and (page is None or bytes(row["response"]["payload"]) == by_id[int(page)])
        else:
            assert row["response"]["payload"] is None


def test_small_payloads_are_never_revisits(spark):
    typed = warc.with_types(pages(spark, PAGES), least_bytes=12)
    assert typed.where("refers_to is not null").count() == 0


def test_files_are_plain_warc(spark):
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.with_types(pages(spark, PAGES[:2])), folder)
    records = []
    for file in Path(folder.removeprefix("file:")).rglob("*.gz"):
        with gzip.open(file) as opened:
            records += list(warc.parse(opened.read(), True))
    assert Counter(r["type"] for r in records) == {"request": 2, "metadata": 2, "response": 1, "revisit": 1}
    names = {r["record_id"] for r in records}
    assert len(names) == 6 and all(r["concurrent_to"] in names for r in records if r["type"] in ("request", "metadata"))


def test_orphans_and_broken_archives(spark):
    columns = "record_id string, type string, concurrent_to string"
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("q0", "request", "r1"), ("m9", "metadata", "gone")]
    found = {r["capture_id"]: r for r in warc.captures(spark.createDataFrame(rows, columns)).collect()}
    assert found["r1"]["request"]["record_id"] == "q0" and found["r1"]["metadata"] is None
    assert found["gone"]["response"] is None
    whole = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 5\r\n\r\nGET /\r\n\r\n"
    assert len(list(warc.parse(whole * 2, True))) == 2
    for broken in (whole[:-6], b"no archive\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(broken, True))


def test_base32(spark):
    texts = ["", "a", "é" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(warc.base32_sha1(rows.t)).collect()]
    assert found == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]


def test_only_shared_payloads_move(spark):
    rows = [(k, f"http://{k}/", f"<p>{k}</p>") for k in range(2000)] + [(3000 + k, "u", f"<p>{k % 10}</p>") for k in range(40)]
    shared = warc.shared_payloads(pages(spark, rows))
    assert {r["last"] for r in shared.collect()} == {3030 + k for k in range(10)}
    meets = warc.may_be_shared(warc._typed(pages(spark, rows)), shared).where("meets").collect()
    assert {r["page_id"] for r in meets} >= {*range(10), *range(3000, 3040)} and len(meets) < 100
    typed = warc.with_types(pages(spark, rows), shared=shared)
    found = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], "response" if r["refers_to"] is None else "revisit", r["refers_to"]) for r in typed.collect())
    assert found == expected(rows)
