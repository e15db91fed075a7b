"""Array files cut at any byte against a JSON parser that sees them whole."""

from __future__ import annotations

import json
import random

import pytest

from cartlens.sources.arrays import read_arrays
from cartlens.sources.landing import backfill, land_arrays, read_landing
from cartlens.sources.sales import read_sales
from cartlens.sources.schema import LANDED_FIELDS, RECORD
from test_ingest import D1, D2, put, record, statuses


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def place(tmp_path, texts):
    folder = tmp_path / "landing" / f"date={D1}" / "drop=1"
    folder.mkdir(parents=True)
    for k, text in enumerate(texts):
        (folder / f"part{k}.json").write_text(text)
    return str(tmp_path / "landing")


def read(spark, landing):
    return read_arrays(spark, [f"{landing}/date={D1}"], landing, RECORD, "date date, drop string")


def plain(value):
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def odd_record(r):
    texts = ["}", "{", '"', "\\", "a}b{c", '\\"}', "]", "[", ",", "é}", "x" * r.randint(0, 900), "\n", ""]
    row = {name: r.choice([r.choice(texts), r.randint(-5, 99), None, "".join(r.choices(texts, k=4))]) for name in LANDED_FIELDS}
    row["extra"] = r.choice([{"deep": {"er": ["}", {"a": "{"}]}}, [1, {}], "}", 1])
    return row


@pytest.mark.parametrize("indent", [None, 1])
def test_like_a_whole_parser(spark, tmp_path, small_splits, indent):
    r = random.Random(indent or 0)
    files = [[odd_record(r) for _ in range(n)] for n in (60, 1, 0, 17)]
    landing = place(tmp_path, [json.dumps(f, indent=indent, ensure_ascii=k % 2 == 0) for k, f in enumerate(files)])
    found = read(spark, landing)
    rows = found.collect()
    assert all(row["_corrupt_record"] is None for row in rows)
    expected = [tuple(plain(x[name]) for name in LANDED_FIELDS) for f in files for x in f]
    assert sorted((tuple(row[name] for name in LANDED_FIELDS) for row in rows), key=str) == sorted(expected, key=str)
    assert {(row["date"], row["drop"]) for row in rows} == {(D1, "1")}


def test_a_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    landing = place(tmp_path, [json.dumps([record(i, D1) for i in range(200)])])
    pieces = spark.read.option("lineSep", "}").text(f"{landing}/date={D1}")
    assert pieces.rdd.getNumPartitions() > 20
    assert read(spark, landing).count() == 200


BROKEN = {
    "no end": '[{"client_id": 1}, {"client_id": 2}',
    "no start": '{"client_id": 1}, {"client_id": 2}]',
    "cut in a string": '[{"client_id": 1}, {"client_id": "2',
    "cut in an object": '[{"client_id": 1}, {"client_id": ',
    "no comma": '[{"client_id": 1} {"client_id": 2}]',
    "two arrays": '[{"client_id": 1}][{"client_id": 2}]',
    "one brace too many": '[{"client_id": 1}}]',
    "a number": '[{"client_id": 1}, 7]',
    "words behind it": '[{"client_id": 1}] and more',
    "not JSON": "no array at all",
    "bad object": '[{"client_id": 1}, {client_id: 2,}]',
    "comma first": '[,{"client_id": 1}]',
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_files_are_told(spark, tmp_path, kind):
    landing = place(tmp_path, [BROKEN[kind], json.dumps([record(1, D1)])])
    assert any(row["_corrupt_record"] is not None for row in read(spark, landing).collect())


@pytest.mark.parametrize("text", ["", "[]", " [ \n ] ", '[{"client_id": 1}]', ' [ {"client_id": 1} ] \n'])
def test_whole_files_are_not(spark, tmp_path, text):
    landing = place(tmp_path, [text])
    rows = read(spark, landing).collect()
    assert [row["_corrupt_record"] for row in rows] == [None] * text.count("{")


def test_a_landed_array_comes_back(spark, tmp_path, small_splits):
    rows = [{**{k: str(v) for k, v in record(i, D1 if i % 3 else D2).items()}, "date": D1 if i % 3 else D2} for i in range(50)]
    names = ["date", *LANDED_FIELDS]
    frame = spark.createDataFrame([tuple(row[n] for n in names) for row in rows], "date date, " + ", ".join(f"{n} string" for n in LANDED_FIELDS))
    landing = str(tmp_path / "landing")
    land_arrays(frame, landing, "1")
    assert "collect_list" not in frame._jdf.queryExecution().toString()
    found = sorted(tuple(r[n] for n in names) for r in read_landing(spark, landing, True).collect())
    assert found == sorted(tuple(row[n] for n in names) for row in rows)
    status = statuses(backfill(spark, landing, str(tmp_path / "sales"), D1, D2, array=True))
    assert status == {D1: (33, 0, 33, "loaded"), D2: (17, 0, 17, "loaded")}
    assert read_sales(spark, str(tmp_path / "sales")).count() == 50


def test_a_broken_array_fails_its_day_only(spark, tmp_path):
    landing, table = tmp_path / "landing", str(tmp_path / "sales")
    put(landing, D1, "1", [record(1, D1)], array=True)
    put(landing, D2, "1", [record(2, D2)], array=True)
    part = landing / f"date={D2}" / "drop=1" / "part.json"
    part.write_text(part.read_text().rstrip().removesuffix("]"))
    found = statuses(backfill(spark, str(landing), table, D1, D2, array=True))
    assert [s[-1] for s in found.values()] == ["loaded", "failed"]
