"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import WHOLE, queries
from cartlens.operators.shared import SharedSales
from cartlens.plans.catalog import REPORTS, report
from cartlens.sources.sales import sales_from_order_lines

SMALL = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Plans as on a cluster, where no fact table fits a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = queries()
    yield {name: plan(found[name](spark, SMALL)) for name in REPORTS}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_python_no_cross_product_and_no_row_sort_before_aggregation(plans):
    for name, text in plans.items():
        for banned in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval"):
            assert banned not in text, (name, banned)
        # A keyed sort aggregation would sort every sales row.
        assert not re.search(r"SortAggregate\(key=\[[^\]]", text), name


def test_scans_read_only_what_a_report_needs(plans):
    def columns(name):
        return set(re.findall(r"[lo]_[a-z]+(?=#)", " ".join(re.findall(r"FileScan parquet \[([^\]]*)\]", plans[name]))))

    assert columns("c07_cohort_retention") == {"l_orderkey", "l_quantity", "o_orderkey", "o_custkey", "o_orderdate"}
    assert columns("c13_repeat_rate") == columns("c07_cohort_retention")
    assert "o_custkey" not in columns("a12_discount_bands")


def test_period_reaches_the_scan(spark):
    frame = queries()["c07_cohort_retention"](spark, SMALL)
    scans = re.findall(r"PushedFilters: \[(.*?)\]", frame._jdf.queryExecution().explainString(
        frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert any("GreaterThanOrEqual(o_orderdate" in s and "LessThan(o_orderdate" in s for s in scans)


def test_a_client_is_shuffled_once_for_retention(plans):
    """Row join (2), clients, month sets, cells, cohorts, final order."""
    assert plans["c07_cohort_retention"].count("Exchange") == 7


def test_buyers_are_counted_without_distinct_pairs(plans):
    """What is shuffled for buyers is keyed by words of clients, and combined before."""
    text = plans["m2_product_reach"]
    assert text.count("partial_bit_or") == 2
    assert not re.search(r"keys=\[product_id#\d+L?, client_id#\d+L?\]", text)


def test_class_cuts_do_not_sort_the_products(plans):
    """Only the few rows of the result are range-partitioned, by their class."""
    for name in ("a02_abc_summary", "a04_dual_abc_summary", "m6_dual_abc_shares"):
        assert set(re.findall(r"rangepartitioning\((\w+)#", plans[name])) <= {"abc_class"}, name


def test_rank_limit_runs_before_the_shuffle(plans):
    assert re.search(r"WindowGroupLimit .*Partial", plans["c14_time_to_second_day"])


def test_every_query_has_columns_with_stable_names(spark):
    frame = sales_from_order_lines(spark, SMALL, WHOLE.start, WHOLE.end)
    assert frame.columns[:3] == ["client_id", "gender", "purchase_date"]
    assert frame.count() == 6000


def formatted(frame) -> str:
    mode = frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize(
    ("name", "behind"),
    [("c10_ltv_fixed_cohorts", "1996-01-01"), ("c11_retention_revenue", "1996-01-01"), ("c12_retention_scenarios", "1995-08-01")],
)
def test_fixed_cohorts_read_only_the_months_they_use(spark, name, behind):
    scans = re.findall(r"PushedFilters: \[(.*?)\]\n", formatted(queries()[name](spark, SMALL)))
    assert any(f"LessThan(o_orderdate,{behind}" in s for s in scans), scans


def test_no_row_is_multiplied_for_distinct_counts(plans):
    assert not any("Expand" in text for text in plans.values())


def test_single_tasks_get_combined_rows_only(plans):
    """Below an exchange into one partition stands an aggregate, or a table made of one."""
    for name, text in plans.items():
        lines = [re.sub(r"^[\s:|+-]*(\*\(\d+\) )?", "", line) for line in text.splitlines()]
        for at, line in enumerate(lines):
            if line.startswith("Exchange SinglePartition"):
                below = next(x for x in lines[at + 1 :] if not re.match(r"(Project|Filter|Sort|Window|InputAdapter|WholeStage|Generate)\b", x))
                assert re.match(r"(HashAggregate|ObjectHashAggregate|SortAggregate|LocalTableScan|Range|Expand)", below), (name, below)


def test_shared_blocks_are_read_by_column(spark):
    batch = SharedSales(sales_from_order_lines(spark, SMALL, WHOLE.start, WHOLE.end))
    report("c07_cohort_retention", batch, WHOLE).collect()
    text = formatted(report("c07_cohort_retention", batch, WHOLE))
    assert re.findall(r"ReadSchema: (\S+)", text) == ["struct<client_id:bigint,month:int>"]
