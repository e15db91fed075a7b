"""Snapshot document, CSV export, SQL views, shared blocks and the command line."""

from __future__ import annotations

import csv
import json
from dataclasses import replace
from datetime import date
from pathlib import Path

import pytest

from cartlens import Params
from cartlens.__main__ import parse, run
from cartlens.operators.shared import SharedSales
from cartlens.plans.catalog import register_views, report
from cartlens.sources.sales import write_sales
from cartlens.sources.snapshot import export_csv, read_records, write_snapshot

P = Params()


@pytest.fixture(scope="module")
def shop(make_sales):
    rows = []
    for client in range(40):
        for step in range(client % 5 + 1):
            month, product = (client * 5 + step * 3) % 12 + 1, (client * step) % 11
            rows.append({"client_id": client, "product_id": product, "purchase_date": date(2023, month, step + 1),
                         "quantity": step + 1, "price_per_item": 10 + product, "discount_per_item": product % 3,
                         "total_price": (10 + product - product % 3) * (step + 1), "gender": "F"})
    return make_sales(rows).cache()


def csv_rows(folder):
    found = []
    for part in sorted(Path(folder).glob("part-*.csv")):
        found += list(csv.DictReader(part.open(encoding="utf-8")))
    return found


def test_published_document_is_read_and_exported(spark, tmp_path):
    document = {
        "metadata": {"schema_version": 1},
        "assortment_actions": [
            {"group": "core", "sku_count": 3, "sku_share_pct": 60.0, "revenue_share_pct": 71.5, "units_share_pct": 33.25},
            {"group": "rest", "sku_count": 2, "sku_share_pct": 40.0, "revenue_share_pct": None, "units_share_pct": None},
        ],
        "repeat_rate": [{"window_days": 30, "eligible_customers": 10, "repeat_customers": 3, "repeat_rate_pct": 30.0}],
    }
    path = tmp_path / "summary.json"
    path.write_text(json.dumps(document, indent=2))
    assert read_records(spark, str(path), "assortment_actions").count() == 2
    export_csv(spark, str(path), str(tmp_path / "csv"), ["assortment_actions", "repeat_rate"])
    rows = csv_rows(tmp_path / "csv" / "assortment_actions")
    assert list(rows[0]) == ["group", "sku_count", "sku_share_pct", "revenue_share_pct", "units_share_pct"]
    assert rows[0]["revenue_share_pct"] == "71.5"
    assert rows[1]["revenue_share_pct"] == "" and rows[1]["units_share_pct"] == ""
    assert csv_rows(tmp_path / "csv" / "repeat_rate")[0]["repeat_customers"] == "3"


def test_snapshot_of_computed_lists(spark, shop, tmp_path):
    path = str(tmp_path / "snapshot")
    write_snapshot(SharedSales(shop), P, path)
    (part,) = Path(path).glob("part-*.json")
    document = json.loads(part.read_text())
    assert list(document) == ["abc_revenue", "dual_abc", "purchase_frequency", "rfm_segments", "repeat_rate",
                              "cohort_metrics"]
    assert sum(r["sku_count"] for r in document["abc_revenue"]) == 11
    assert [r["month_number"] for r in document["cohort_metrics"]] == list(range(7))
    assert read_records(spark, path, "repeat_rate").collect() == report("c13_repeat_rate", shop, P).collect()


def test_shared_blocks_give_the_same_reports(shop):
    shared = SharedSales(shop)
    one_per_block = ("a04_dual_abc_summary", "a06_xyz_product_scores", "a10_abc_xyz_segments", "a12_discount_bands",
                     "a16_candidate_monthly_sales", "c05_rfm_scores", "c07_cohort_retention", "c10_ltv_fixed_cohorts",
                     "c12_retention_scenarios", "c13_repeat_rate", "m1_amount_check")
    for name in one_per_block:
        assert report(name, shared, P).collect() == report(name, shop, P).collect(), name


def test_reports_as_sql_views(spark, shop):
    names = register_views(shop, P, ["a02_abc_summary", "c13_repeat_rate"])
    assert names == ["a02_abc_summary", "c13_repeat_rate"]
    assert spark.sql("select sum(products_count) from a02_abc_summary").first()[0] == 11
    with pytest.raises(KeyError):
        report("a99_nothing", shop)


def test_command_line(spark, shop, tmp_path):
    table, out = str(tmp_path / "sales"), str(tmp_path / "out")
    write_sales(shop, table)
    run(parse(["reports", "--sales", table, "--out", out, "--name", "c13_repeat_rate", "a02_abc_summary"]), spark)
    assert [r["window_days"] for r in csv_rows(f"{out}/c13_repeat_rate")] == ["30", "60", "90"]
    assert {r["abc_class"] for r in csv_rows(f"{out}/a02_abc_summary")} <= {"A", "B", "C"}
    run(parse(["verify", "--sales", table]), spark)


def test_parameters_on_the_command_line():
    args = parse(["reports", "--sales", "s", "--out", "o", "--param", "xyz_cuts=(50, 80)", "--param", "segment_language=en",
                  "--param", "end=2024-06-01"])
    assert replace(P, **dict(args.param)) == replace(P, xyz_cuts=(50, 80), segment_language="en", end=date(2024, 6, 1))
    with pytest.raises(SystemExit):
        parse(["reports", "--sales", "s", "--out", "o", "--param", "nothing=1"])


def test_params():
    assert (P.n_months, P.last_month, P.month_start(13)) == (12, date(2023, 12, 1), date(2024, 2, 1))
    assert Params(start=date(2023, 1, 15), end=date(2023, 3, 1)).n_months == 2
    with pytest.raises(ValueError):
        Params(start=date(2023, 1, 1), end=date(2023, 1, 1))
