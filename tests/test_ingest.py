"""Landed day files: replacement, failures, stray dates, empty days; batch and stream."""

from __future__ import annotations

import json
from datetime import date
from pathlib import Path

import pytest

from cartlens.session import shared_folder
from cartlens.sources import landing as landing_module
from cartlens.sources.landing import backfill, land, land_arrays, load_day, read_landing, typed
from cartlens.sources.sales import load_range, read_sales, rows_per_day
from cartlens.sources.schema import LANDED_FIELDS
from cartlens.streaming.daily import start_daily_ingest

D1, D2, D3, D4 = (date(2023, 1, day) for day in (1, 2, 3, 4))


def record(client, day, **changes):
    row = {
        "client_id": client,
        "gender": "F",
        "purchase_datetime": f"{day}T10:30:00",
        "purchase_time_as_seconds_from_midnight": 37800,
        "product_id": 7,
        "quantity": 2,
        "price_per_item": 100,
        "discount_per_item": 10,
        "total_price": 180.0,
    }
    return {**row, **changes}


def put(landing, day, drop, rows, array=False):
    folder = landing / f"date={day}" / f"drop={drop}"
    folder.mkdir(parents=True, exist_ok=True)
    text = json.dumps(rows, indent=1) if array else "\n".join(json.dumps(row) for row in rows)
    (folder / "part.json").write_text(text)


def stored(spark, table):
    rows = read_sales(spark, table).collect()
    return sorted((str(r["purchase_date"]), r["client_id"]) for r in rows)


def statuses(frame):
    return {r["date"]: (r["received"], r["quarantined"], r["loaded"], r["status"]) for r in frame.collect()}


@pytest.fixture
def place(tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    return landing, str(tmp_path / "sales")


@pytest.mark.parametrize("array", [False, True])
def test_backfill_judges_each_day_alone(spark, place, tmp_path, array):
    landing, table = place
    put(landing, D1, "1", [record(1, D1), record(2, D1), record(3, D2)], array)
    put(landing, D2, "1", [record(4, D2), record(5, D2, quantity="many")], array)
    put(landing, D3, "1", [], array)
    strays = str(tmp_path / "strays")
    found = statuses(backfill(spark, str(landing), table, D1, D4, array, strays))
    assert found == {D1: (3, 1, 2, "loaded"), D2: (2, 0, 0, "failed"), D3: (0, 0, 0, "empty"), D4: (0, 0, 0, "empty")}
    assert stored(spark, table) == [(str(D1), 1), (str(D1), 2)]
    kept_out = spark.read.parquet(strays).collect()
    assert [(r["client_id"], r["purchase_date"], r["date"]) for r in kept_out] == [(3, D2, D1)]


def test_a_new_drop_replaces_its_day_only(spark, place):
    landing, table = place
    put(landing, D1, "1", [record(1, D1), record(2, D1)])
    put(landing, D2, "1", [record(3, D2)])
    backfill(spark, str(landing), table, D1, D2)
    backfill(spark, str(landing), table, D1, D2)
    assert stored(spark, table) == [(str(D1), 1), (str(D1), 2), (str(D2), 3)]
    put(landing, D1, "2", [record(9, D1)])
    backfill(spark, str(landing), table, D1, D1)
    assert stored(spark, table) == [(str(D1), 9), (str(D2), 3)]


def test_a_bad_newer_drop_does_not_hide_the_good_older_one(spark, place):
    landing, table = place
    put(landing, D1, "1", [record(1, D1)])
    put(landing, D1, "2", [record(2, D1), record(3, D1, client_id=None)])
    assert statuses(backfill(spark, str(landing), table, D1, D1)) == {D1: (1, 0, 1, "loaded")}
    assert stored(spark, table) == [(str(D1), 1)]


def test_empty_and_failed_deliveries_keep_the_stored_rows(spark, place):
    landing, table = place
    put(landing, D1, "1", [record(1, D1)])
    put(landing, D2, "1", [record(2, D2)])
    backfill(spark, str(landing), table, D1, D2)
    put(landing, D1, "1", [])
    put(landing, D2, "1", [record(3, D2, price_per_item="x")])
    found = statuses(backfill(spark, str(landing), table, D1, D2))
    assert [s[-1] for s in found.values()] == ["empty", "failed"]
    assert stored(spark, table) == [(str(D1), 1), (str(D2), 2)]


def test_nothing_delivered_at_all(spark, place):
    landing, table = place
    put(landing, D1, "1", [record(1, D1)])
    backfill(spark, str(landing), table, D1, D1)
    put(landing, D2, "1", [])
    found = statuses(backfill(spark, str(landing), table, D2, D3))
    assert found == {D2: (0, 0, 0, "empty"), D3: (0, 0, 0, "empty")}
    assert stored(spark, table) == [(str(D1), 1)]


BAD = {
    "text in a number": {"product_id": "seven"},
    "number out of range": {"quantity": 40000},
    "missing number": {"discount_per_item": None},
    "two letters": {"gender": "FM"},
    "no date": {"purchase_datetime": None},
    "not a date": {"purchase_datetime": "soon"},
    "text total": {"total_price": "free"},
}
GOOD = {
    "fraction is cut": ({"quantity": 2.7}, ("quantity", 2)),
    "number as text": ({"quantity": "3"}, ("quantity", 3)),
    "plain date": ({"purchase_datetime": "2023-01-01"}, ("purchase_date", D1)),
    "zone is ignored": ({"purchase_datetime": "2023-01-01T23:30:00+05:00"}, ("purchase_date", D1)),
    "no gender": ({"gender": None}, ("gender", None)),
    "no total": ({"total_price": None}, ("total_price", None)),
}


def test_which_values_are_usable(spark, place):
    landing, _ = place
    rows = [record(i, D1, **change) for i, change in enumerate([*BAD.values(), *(g[0] for g in GOOD.values())])]
    rows = [{**row, "purchase_time_as_seconds_from_midnight": i} for i, row in enumerate(rows)]
    put(landing, D1, "1", rows)
    found = {r["purchase_time_as_seconds_from_midnight"]: r for r in typed(read_landing(spark, str(landing))).collect()}
    assert [found[i]["good"] for i in range(len(rows))] == [False] * len(BAD) + [True] * len(GOOD)
    for i, (name, (_, (column, value))) in enumerate(GOOD.items(), start=len(BAD)):
        assert found[i][column] == value, name


def test_a_broken_line_fails_the_day(spark, place):
    landing, table = place
    put(landing, D1, "1", [record(1, D1)])
    part = landing / f"date={D1}" / "drop=1" / "part.json"
    part.write_text(part.read_text() + '\n{"client_id": 2, "gen')
    assert statuses(backfill(spark, str(landing), table, D1, D1)) == {D1: (2, 0, 0, "failed")}


def test_single_day_load_raises_on_failure(spark, place):
    landing, table = place
    put(landing, D1, "1", [record(1, D1, quantity=None)])
    with pytest.raises(ValueError):
        load_day(spark, str(landing), table, D1)
    put(landing, D2, "1", [record(2, D2)])
    assert statuses(load_day(spark, str(landing), table, D2)) == {D2: (1, 0, 1, "loaded")}


def test_checks_after_a_load(spark, place):
    landing, table = place
    put(landing, D1, "1", [record(1, D1), record(2, D1)])
    put(landing, D3, "1", [record(3, D3)])
    backfill(spark, str(landing), table, D1, D3)
    sales = read_sales(spark, table)
    assert tuple(load_range(sales).first()) == (D1, D3, 3)
    assert [tuple(r) for r in rows_per_day(sales, D1, D3).collect()] == [(D1, 2)]
    plan = sales.where("purchase_date = '2023-01-03'").select("client_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(purchase_date" in plan


def test_stream_loads_only_what_is_new(spark, place, tmp_path):
    landing, table = place
    checkpoint, status = str(tmp_path / "checkpoint"), str(tmp_path / "status")

    def ingest():
        start_daily_ingest(spark, str(landing), table, checkpoint, status).awaitTermination()

    put(landing, D1, "1", [record(1, D1), record(2, D1), record(3, D2)])
    put(landing, D2, "1", [record(4, D2, quantity="many")])
    ingest()
    assert stored(spark, table) == [(str(D1), 1), (str(D1), 2)]
    put(landing, D1, "2", [record(5, D1)])
    put(landing, D2, "2", [record(6, D2)])
    put(landing, D3, "1", [])
    ingest()
    ingest()
    assert stored(spark, table) == [(str(D1), 5), (str(D2), 6)]
    log = {(r["batch"], r["date"]): r["status"] for r in spark.read.parquet(status).collect()}
    assert log == {(0, D1): "loaded", (0, D2): "failed", (1, D1): "loaded", (1, D2): "loaded"}


def test_a_drop_seen_in_two_batches_is_loaded_whole(spark, place, tmp_path):
    landing, table = place

    def ingest():
        start_daily_ingest(spark, str(landing), table, str(tmp_path / "checkpoint")).awaitTermination()

    put(landing, D1, "1", [record(i, D1) for i in range(5)])
    ingest()
    part = landing / f"date={D1}" / "drop=1" / "late.json"
    part.write_text("\n".join(json.dumps(record(i, D1)) for i in range(5, 8)))
    ingest()
    assert stored(spark, table) == [(str(D1), i) for i in range(8)]


def test_an_older_drop_that_comes_late_changes_nothing(spark, place, tmp_path):
    landing, table = place
    for drop, clients in (("10", range(5)), ("9", range(2))):
        put(landing, D1, drop, [record(i, D1) for i in clients])
        start_daily_ingest(spark, str(landing), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert stored(spark, table) == [(str(D1), i) for i in range(5)]


def test_drops_are_ordered_as_numbers(spark, place):
    landing, table = place
    for drop, client in (("9", 1), ("10", 2), ("zz", 3)):
        put(landing, D1, drop, [record(client, D1)])
    backfill(spark, str(landing), table, D1, D1)
    assert stored(spark, table) == [(str(D1), 2)]


def test_a_lost_day_comes_back_with_the_next_load(spark, place):
    """What a crash between the removal of old files and the move of new ones would leave."""
    landing, table = place
    put(landing, D1, "1", [record(1, D1)])
    put(landing, D2, "1", [record(2, D2)])
    backfill(spark, str(landing), table, D1, D2)
    for file in Path(table, f"purchase_date={D1}").iterdir():
        file.unlink()
    backfill(spark, str(landing), table, D1, D1)
    assert stored(spark, table) == [(str(D1), 1), (str(D2), 2)]


def test_the_staged_copy_goes_when_a_load_fails(spark, place, monkeypatch):
    landing, table = place
    put(landing, D1, "1", [record(1, D1)])
    staged = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("staged-*"))
    before = staged()

    def broken(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(landing_module, "write_sales", broken)
    with pytest.raises(RuntimeError):
        backfill(spark, str(landing), table, D1, D1)
    assert staged() == before


def test_only_requested_days_are_listed(spark, place):
    landing, _ = place
    for day in (D1, D2, D3):
        put(landing, day, "1", [record(1, day)])
    files = read_landing(spark, str(landing), start=D2, end=D2).inputFiles()
    assert [f"date={D2}" in f for f in files] == [True]


def test_landed_drops_appear_as_folders(spark, place):
    landing, table = place
    columns = ", ".join(f"{name} string" for name in LANDED_FIELDS) + ", date date"
    row = tuple(str(record(1, D1)[name]) for name in LANDED_FIELDS)
    rows = spark.createDataFrame([(*row, D1)], columns)
    land(rows, str(landing), "1")
    land(rows, str(landing), "1")
    land_arrays(rows, str(landing), "2")
    assert [p.name for p in landing.iterdir()] == [f"date={D1}"]
    assert sorted(p.name for p in (landing / f"date={D1}").iterdir()) == ["drop=1", "drop=2"]
    assert len(list((landing / f"date={D1}" / "drop=1").glob("*.json"))) == 2
