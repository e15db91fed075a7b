"""Published tables: whole versions, interrupted and overtaken loads, kept totals, clean-up."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import date, timedelta
from pathlib import Path

import pytest

from cartlens import Params
from cartlens.__main__ import parse, run
from cartlens.operators.maintained import PARTS, MaintainedSales, maintained_table
from cartlens.operators.shared import SharedSales
from cartlens.plans.catalog import REPORTS
from cartlens.sources.landing import backfill, load_day
from cartlens.sources.published import PublishedSales, StaleLoad, Version
from cartlens.sources.sales import load_range, read_sales, rows_per_day
from cartlens.streaming.daily import start_daily_ingest
from test_ingest import D1, D2, D3, put, record

# What a load does, in this order; the last makes it visible.
STEPS = ("version", "stage", "_write", "staged_days", "_write_text", "_rename")


def rows(frame):
    return sorted((str(r["purchase_date"]), r["client_id"]) for r in frame.collect())


@pytest.fixture
def place(tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    return landing, str(tmp_path / "sales")


def test_a_load_that_stops_anywhere_leaves_the_old_or_the_new_days_whole(spark, place, monkeypatch):
    landing, path = place
    table = PublishedSales(spark, path, {"client_days": PARTS["client_days"]})
    put(landing, D1, "1", [record(1, D1), record(2, D1)])
    put(landing, D2, "1", [record(3, D2)])
    backfill(spark, str(landing), table, D1, D2)
    old, new = [(str(D1), 1), (str(D1), 2), (str(D2), 3)], [(str(D1), 4), (str(D2), 5), (str(D2), 6)]
    assert rows(table.read()) == old
    put(landing, D1, "2", [record(4, D1)])
    put(landing, D2, "2", [record(5, D2), record(6, D2)])

    def stopped(step, when):
        genuine = getattr(PublishedSales, step)

        def stops(self, *args, **options):
            if when == "after":
                genuine(self, *args, **options)
            raise RuntimeError("stopped")

        with monkeypatch.context() as patched:
            patched.setattr(PublishedSales, step, stops)
            with pytest.raises(RuntimeError, match="stopped"):
                backfill(spark, str(landing), table, D1, D2)
        return rows(table.read()), rows(table.read(part="client_days"))

    for step in STEPS:
        for when in ("before", "after"):
            # Only the rename, which ends the load, makes the new days visible, with all that is made of them.
            if when == "after" and step == "_rename":
                assert stopped(step, when) == (new, new)
            else:
                assert stopped(step, when) == (old, old), (step, when)
    # Run again, it ends as if nothing had happened.
    backfill(spark, str(landing), table, D1, D2)
    assert rows(table.read()) == new


def test_an_overtaken_load_stops(spark, place):
    landing, path = place
    table = PublishedSales(spark, path)
    put(landing, D1, "1", [record(1, D1)])
    backfill(spark, str(landing), table, D1, D1)
    started = table.version()
    other = read_sales(spark, path)
    table.replace(other, started)
    with pytest.raises(StaleLoad):
        table.replace(other, started)
    assert table.version().number == 2 and rows(table.read()) == [(str(D1), 1)]


def test_readers_keep_their_version(spark, place):
    landing, path = place
    table = PublishedSales(spark, path)
    put(landing, D1, "1", [record(1, D1)])
    put(landing, D2, "1", [record(2, D2)])
    backfill(spark, str(landing), table, D1, D2)
    first, frame = table.version(), table.read()
    put(landing, D1, "2", [record(3, D1)])
    load_day(spark, str(landing), table, D1)
    assert rows(frame) == rows(table.read(version=first)) == [(str(D1), 1), (str(D2), 2)]
    assert rows(table.read()) == rows(read_sales(spark, path)) == [(str(D1), 3), (str(D2), 2)]
    assert table.version(1) == first and table.numbers() == [1, 2]
    # Only the folders of the days asked for are read.
    files = table.read(D2, D3).inputFiles()
    assert len(files) == 1 and f"purchase_date={D2}" in files[0]


def test_empty_loads_and_an_empty_table(spark, place):
    landing, path = place
    table = maintained_table(spark, path)
    assert table.version() == Version() and table.read().count() == 0 and not PublishedSales.exists(spark, path)
    assert [tuple(r) for r in table.load_range().collect()] == [(None, None, 0)]
    put(landing, D1, "1", [])
    backfill(spark, str(landing), table, D1, D2)
    assert table.version().number == 0
    assert REPORTS["c01_customer_metrics"](MaintainedSales(table), Params()).count() == 0
    assert [tuple(r) for r in REPORTS["m1_amount_check"](MaintainedSales(table), Params()).collect()] == [(0, 0, None, None)]


def test_counts_come_from_the_manifest(spark, place):
    landing, path = place
    table = PublishedSales(spark, path)
    put(landing, D1, "1", [record(1, D1), record(2, D1)])
    put(landing, D3, "1", [record(3, D3)])
    backfill(spark, str(landing), table, D1, D3)
    assert table.load_range().collect() == load_range(table.read()).collect()
    assert table.rows_per_day(D1, D3).collect() == rows_per_day(table.read(), D1, D3).collect()


def test_counts_of_a_plain_table_come_from_footers(spark, place):
    """No column is read for the range and the rows per day of a stored table: days are folder names, rows stand in footers."""
    landing, path = place
    put(landing, D1, "1", [record(1, D1), record(2, D1)])
    put(landing, D3, "1", [record(3, D3)])
    backfill(spark, str(landing), path, D1, D3)
    sales = read_sales(spark, path)
    for frame, expected in ((load_range(sales), [(D1, D3, 3)]), (rows_per_day(sales, D1, D3), [(D1, 2)])):
        assert [tuple(r) for r in frame.collect()] == expected
        assert "ReadSchema: struct<>" in frame._jdf.queryExecution().executedPlan().toString()


def test_vacuum_keeps_what_versions_name_and_what_is_new(spark, place):
    landing, path = place
    table = maintained_table(spark, path)
    for drop in ("1", "2", "3"):
        put(landing, D1, drop, [record(int(drop), D1)])
        backfill(spark, str(landing), table, D1, D1)
    abandoned = table.stage(read_sales(spark, path))
    assert table.vacuum(keep=2) == [] and table.numbers() == [2, 3]
    gone = table.vacuum(keep=1, hours=0)
    assert abandoned in gone and len(gone) == 3 and table.numbers() == [3]
    assert rows(table.read()) == [(str(D1), 3)]
    for part in ("sales", *PARTS):
        assert len([f for f in Path(path, part).iterdir() if f.name.startswith("load=")]) == 1


def test_stream_into_a_published_table(spark, place, tmp_path):
    landing, path = place
    table = maintained_table(spark, path)
    put(landing, D1, "1", [record(1, D1), record(2, D1)])
    start_daily_ingest(spark, str(landing), table, str(tmp_path / "c")).awaitTermination()
    put(landing, D1, "2", [record(9, D1)])
    put(landing, D2, "1", [record(3, D2)])
    start_daily_ingest(spark, str(landing), table, str(tmp_path / "c")).awaitTermination()
    assert rows(table.read()) == [(str(D1), 9), (str(D2), 3)] and table.version().number == 2


def delivered(seed, day, n):
    r = random.Random(seed)
    return [
        record(
            r.randint(1, 40), day, product_id=r.randint(1, 25), quantity=r.randint(0, 5), price_per_item=r.randint(50, 900),
            discount_per_item=r.randint(0, 40), total_price=r.randint(-50, 5000) / 4, gender=r.choice(["F", "M", None]),
        )
        for _ in range(n)
    ]


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a))


def test_reports_from_kept_totals_are_those_from_the_rows(spark, place, monkeypatch):
    landing, path = place
    days = [date(2023, 1, 1) + timedelta(days=k) for k in range(0, 240, 6)]
    for k, day in enumerate(days):
        put(landing, day, "1", delivered(k, day, 25))
    table = maintained_table(spark, path)
    backfill(spark, str(landing), table, days[0], days[-1])
    put(landing, days[3], "2", delivered(99, days[3], 10))
    read = []
    genuine = PublishedSales._write

    def watched(self, frame, part, load):
        read.append({str(Path(f).parent.name) for f in frame.inputFiles()} if part != "sales" else set())
        genuine(self, frame, part, load)

    monkeypatch.setattr(PublishedSales, "_write", watched)
    load_day(spark, str(landing), table, days[3])
    # The totals of the redelivered day are made from its own rows.
    assert read[1:] == [{f"purchase_date={days[3]}"}] * len(PARTS)

    p = replace(Params(), review_max_units=15)
    facts = table.read()
    with MaintainedSales(table) as kept, SharedSales(facts) as whole:
        for name, report in REPORTS.items():
            found, expected = report(kept, p), report(whole, p)
            if name.startswith(("m1_broken", "m2_")):
                continue
            assert "/sales/load=" not in str(found._jdf.queryExecution().optimizedPlan()), name
            found, expected = found.collect(), expected.collect()
            assert len(found) == len(expected), name
            assert all(close(x, y) for a, b in zip(found, expected) for x, y in zip(a, b)), name
        assert not any("/sales/load=" in f for block in kept._blocks.values() for f in block.inputFiles())
        folders = list(kept._folders)
        assert folders and all(Path(f.removeprefix("file://")).exists() for f in folders)
    assert not any(Path(f.removeprefix("file://")).exists() for f in folders)


def test_command_line(spark, place, tmp_path, capsys):
    landing, path = place
    put(landing, D1, "1", [record(1, D1), record(2, D1)])
    run(parse(["daily", "--landing", str(landing), "--sales", path, "--day", str(D1), "--published"]), spark)
    put(landing, D1, "2", [record(3, D1)])
    # Once begun as a published table it stays one.
    run(parse(["daily", "--landing", str(landing), "--sales", path, "--day", str(D1)]), spark)
    assert PublishedSales(spark, path).version().number == 2
    capsys.readouterr()
    run(parse(["verify", "--sales", path]), spark)
    assert f"{D1}\t{D1}\t1" in capsys.readouterr().out
    run(parse(["reports", "--sales", path, "--out", str(tmp_path / "out"), "--name", "c01_customer_metrics"]), spark)
    assert "3" in "".join(f.read_text() for f in Path(tmp_path / "out").rglob("*.csv"))
    run(parse(["vacuum", "--sales", path, "--keep", "1", "--hours", "0"]), spark)
    assert PublishedSales(spark, path).numbers() == [2]


def scanned(frame) -> int:
    """Rows that the scans of a plan gave to the steps above, after Parquet left out row groups."""
    frame.collect()
    todo, total = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def test_a_few_products_are_found_in_few_row_groups(spark, place):
    landing, path = place
    days = [D1 + timedelta(days=k) for k in range(30)]
    # Every day sells products from one end of the range to the other; product 4321 is sold on two days only.
    for k, day in enumerate(days):
        products = [1, *range(100 + k, 9000, 97), 9999] + [4321] * (k in (3, 17))
        put(landing, day, "1", [record(i, day, product_id=x) for i, x in enumerate(products)])
    table = PublishedSales(spark, path)
    plain = f"{path}-plain"
    backfill(spark, str(landing), table, days[0], days[-1])
    backfill(spark, str(landing), plain, days[0], days[-1])
    p = replace(Params(), candidate_ids=(4321,))
    for sales in (table.read(), read_sales(spark, plain)):
        report = REPORTS["a16_candidate_monthly_sales"](sales, p)
        assert [(r["product_id"], r["units_sold"]) for r in report.collect()] == [(4321, 4)]
        assert scanned(report) <= sales.count() * 0.2
