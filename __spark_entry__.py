
from __future__ import annotations

import importlib
import importlib.util
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens import Params
from cartlens.functions.numbers import half_up
from cartlens.operators import clients, cohorts, facts, products
from cartlens.operators.maintained import MaintainedSales, maintained_table
from cartlens.plans.assortment import a16_candidate_monthly_sales, candidate_months
from cartlens.plans.catalog import REPORTS
from cartlens.session import shared_folder
from cartlens.sources.events import day_deliveries
from cartlens.sources.landing import backfill, land, land_arrays, load_day, read_landing, typed
from cartlens.sources.sales import load_range, read_sales, rows_per_day, sales_from_order_lines
from cartlens.sources.snapshot import RECORDS, export_csv, read_csv, write_snapshot
from cartlens.streaming.daily import start_daily_ingest
from oracles.sql import Oracle

# The whole history of the order tables. Bounds of the study that fit its own
# data only are set so that every class and band occurs here.
WHOLE = Params(
    start=date(1995, 1, 1),
    end=date(2001, 9, 1),
    xyz_cuts=(170, 205),
    xyz_classic_cuts=(10, 175),
    recency_cuts=(85, 156, 253, 429),
    frequency_cuts=(6, 8, 10, 12),
    monetary_cuts=(1388428, 1783392, 2148678, 2617127),
    review_max_revenue=1100000,
    review_max_units=640,
    review_min_cv=220,
    discount_band=1,
)
# Products for the report on a fixed list; the last is unknown.
LISTED = (1, 5, 17, 42, 150, 99999999)
# One calendar year with the bounds of the study, and English segment names.
YEAR = Params(start=date(1997, 1, 1), end=date(1998, 1, 1), segment_language="en", review_max_units=15)

# Three months of it, for tables that are written day by day.
QUARTER = replace(YEAR, end=date(1997, 4, 1))


def _sales(spark: SparkSession, folder: str, p: Params, **options) -> DataFrame:
    return sales_from_order_lines(spark, folder, p.start, p.end, **options)


def entry(spark: SparkSession) -> DataFrame:
    return REPORTS["a02_abc_summary"](_sales(spark, "/root/testdata/sf0.001", WHOLE), WHOLE)


# Interpolated day counts, which two engines compute alike up to their last binary digits.
INTERPOLATED = {
    "c03_rfm_percentiles": [f"{letter}_p{step}" for letter in "rf" for step in (20, 40, 60, 80)],
    "c14_time_to_second_day": ["p25_days", "median_days", "p75_days", "p90_days"],
}


def _report(name: str, p: Params):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = REPORTS[name](_sales(spark, folder, p), p)
        return found.withColumns({c: half_up(F.col(c), 6) for c in INTERPOLATED.get(name, ())})

    return run


def _listed_months(p: Params):
    """Monthly sales of a fixed list of products."""
    listed = replace(p, candidate_ids=LISTED)
    return lambda spark, folder: a16_candidate_monthly_sales(_sales(spark, folder, listed), listed)


def _amounts(name: str, p: Params):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = REPORTS[name](_sales(spark, folder, p, billed=True), p)
        decimals = [c for c, kind in found.dtypes if kind.startswith("decimal")]
        return found.withColumns({c: F.col(c).cast("double") for c in decimals})

    return run


def _candidate_months(p: Params):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return candidate_months(_sales(spark, folder, p), p)

    return run


# Blocks that no report shows on its own.
BLOCKS = {
    "b01_base_sales": lambda s, p: facts.base_sales(s, p).selectExpr(
        "client_id", "purchase_date", "product_id", "quantity", "cast(total_price as double) as total_price"
    ),
    "b02_product_metrics": lambda s, p: products.product_metrics(s, p).withColumn(
        "revenue", F.col("revenue").cast("double")
    ),
    "b07_dense_monthly_units": products.dense_monthly_units,
    "b09_product_segments": lambda s, p: products.abc_xyz_products(s, p).select(
        "product_id", "abc_class", "xyz_class", "segment"
    ),
    "b10_first_months": cohorts.first_months,
    "b13_activity_cells": lambda s, p: cohorts.revenue_cells(s, p).select(
        "cohort", "month_number", "active_clients", F.col("revenue").cast("double").alias("revenue")
    ),
    "b18_purchase_days": clients.purchase_days,
    "b20_client_segments": lambda s, p: clients.rfm_segments(clients.client_metrics(s, p), p).select(
        "client_id", "rfm_score", "segment"
    ),
}


def _block(name: str, p: Params):
    return lambda spark, folder: BLOCKS[name](_sales(spark, folder, p), p)


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


STRAY_COLUMNS = (
    "drop string, client_id bigint, gender string, purchase_date date, purchase_time_as_seconds_from_midnight int, "
    "product_id bigint, quantity int, price_per_item bigint, discount_per_item bigint, total_price decimal(18,2)"
)
# The months of the `events` table.
EVENT_DAYS = (date(2024, 1, 1), date(2024, 2, 1))


def _first_load(spark: SparkSession, folder: str):
    """Land every delivery once and load them; returns landing, table and status."""
    work = _new_folder(spark)
    landing, table = f"{work}/landing", f"{work}/sales"
    land(day_deliveries(spark, folder), landing, "1")
    return landing, table, backfill(spark, landing, table, *EVENT_DAYS)


def _corrected(spark: SparkSession, folder: str) -> DataFrame:
    """The second delivery of every day: without errors and zero values."""
    return day_deliveries(spark, folder).where("event_type <> 'error' and price_per_item <> 'n/a'")


def _stored(spark: SparkSession, table: str) -> DataFrame:
    return read_sales(spark, table).withColumn("total_price", F.col("total_price").cast("double"))


def _backfill_status(spark: SparkSession, folder: str) -> DataFrame:
    return _first_load(spark, folder)[2]


def _loaded_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, _first_load(spark, folder)[1])


def _replaced_rows(spark: SparkSession, folder: str) -> DataFrame:
    landing, table, _ = _first_load(spark, folder)
    land(_corrected(spark, folder), landing, "2")
    backfill(spark, landing, table, *EVENT_DAYS)
    return _stored(spark, table)


def _after_streams(*parts):
    """The stored rows after each of the given drops has landed and the stream has run."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        work = _new_folder(spark)
        landing, table = f"{work}/landing", f"{work}/sales"
        for drop, condition in parts:
            land(_corrected(spark, folder).where(condition), landing, drop)
            start_daily_ingest(spark, landing, table, f"{work}/checkpoint").awaitTermination()
        return _stored(spark, table)

    return run


def _numeric_drops(spark: SparkSession, folder: str) -> DataFrame:
    work = _new_folder(spark)
    landing, table = f"{work}/landing", f"{work}/sales"
    land(_corrected(spark, folder).where("event_type = 'click'"), landing, "9")
    land(_corrected(spark, folder), landing, "10")
    backfill(spark, landing, table, *EVENT_DAYS)
    return _stored(spark, table)


def _array_rows(spark: SparkSession, folder: str) -> DataFrame:
    work = _new_folder(spark)
    land_arrays(day_deliveries(spark, folder), f"{work}/landing", "1")
    backfill(spark, f"{work}/landing", f"{work}/sales", *EVENT_DAYS, array=True)
    return _stored(spark, f"{work}/sales")


def _one_day(spark: SparkSession, folder: str) -> DataFrame:
    work = _new_folder(spark)
    land(_corrected(spark, folder), f"{work}/landing", "1")
    load_day(spark, f"{work}/landing", f"{work}/sales", date(2024, 1, 10))
    return _stored(spark, f"{work}/sales")


def _redelivered(rows):
    """The stored rows after a second landing has been loaded over the corrected deliveries."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        work = _new_folder(spark)
        table = f"{work}/sales"
        for landing, delivered in (("first", _corrected(spark, folder)), ("second", rows(spark, folder))):
            land(delivered, f"{work}/{landing}", "1")
            backfill(spark, f"{work}/{landing}", table, *EVENT_DAYS)
        return _stored(spark, table)

    return run


def _published_day(spark: SparkSession, folder: str):
    """A published table after a whole load, a load that stops before it is published, and the load of one day."""
    work = _new_folder(spark)
    table = maintained_table(spark, f"{work}/sales")
    land(day_deliveries(spark, folder), f"{work}/first", "1")
    land(_corrected(spark, folder), f"{work}/second", "1")
    backfill(spark, f"{work}/first", table, *EVENT_DAYS)
    table.stage(typed(read_landing(spark, f"{work}/second")).where("purchase_date = date"))
    load_day(spark, f"{work}/second", table, date(2024, 1, 10))
    return table


def _maintained(name: str, p: Params):
    """A report from the daily totals of a published table of which one day was delivered again."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        table = maintained_table(spark, f"{_new_folder(spark)}/sales")
        sales = _sales(spark, folder, p)
        again = F.col("purchase_date") == F.lit(date(1997, 2, 3))
        wrong = F.when(again, F.col("quantity") * 3).otherwise(F.col("quantity"))
        table.replace(sales.withColumn("quantity", wrong))
        table.replace(sales.where(again))
        found = REPORTS[name](MaintainedSales(table), p)
        return found.withColumns({c: half_up(F.col(c), 6) for c in INTERPOLATED.get(name, ())})

    return run


def _quarantined_rows(spark: SparkSession, folder: str) -> DataFrame:
    work = _new_folder(spark)
    land(day_deliveries(spark, folder), f"{work}/landing", "1")
    backfill(spark, f"{work}/landing", f"{work}/sales", *EVENT_DAYS, quarantine=f"{work}/strays")
    strays = spark.read.schema(f"{STRAY_COLUMNS}, date date").parquet(f"{work}/strays")
    return strays.withColumn("total_price", F.col("total_price").cast("double"))


def _streamed_rows(spark: SparkSession, folder: str) -> DataFrame:
    work = _new_folder(spark)
    landing, table = f"{work}/landing", f"{work}/sales"
    for drop, rows in (("1", day_deliveries(spark, folder)), ("2", _corrected(spark, folder))):
        land(rows, landing, drop)
        start_daily_ingest(spark, landing, table, f"{work}/checkpoint").awaitTermination()
    return _stored(spark, table)


def _exported(name: str, p: Params):
    """A record list by way of the snapshot document and its CSV file."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        work = _new_folder(spark)
        write_snapshot(_sales(spark, folder, p), p, f"{work}/snapshot", [name])
        (path,) = export_csv(spark, f"{work}/snapshot", f"{work}/csv", [name])
        return read_csv(spark, path, RECORDS[name])

    return run


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found = {}
    for suffix, p in (("", WHOLE), ("__year", YEAR)):
        texts = Oracle(p).reports()
        billed = Oracle(p, billed=True).reports()
        for name in REPORTS:
            if name == "a16_candidate_monthly_sales":
                found[name + suffix] = (_candidate_months(p), texts[name])
            elif name.startswith("m1_"):
                found[name + suffix] = (_amounts(name, p), billed[name])
            else:
                found[name + suffix] = (_report(name, p), texts[name])
    # The same reports with a global order that is cut into many slices.
    sliced = replace(WHOLE, rows_per_slice=300)
    for name in ("a01_abc_product_scores", "a08_cv_distribution", "a10_abc_xyz_segments", "c03_rfm_percentiles"):
        found[name + "__sliced"] = (_report(name, sliced), Oracle(sliced).reports()[name])

    quarter = Oracle(QUARTER).reports()
    for name in (
        "a06_xyz_product_scores",
        "a10_abc_xyz_segments",
        "a12_discount_bands",
        "c01_customer_metrics",
        "c07_cohort_retention",
        "c11_retention_revenue",
        "c14_time_to_second_day",
        "m1_amount_check",
    ):
        found[f"{name}__maintained"] = (_maintained(name, QUARTER), quarter[name])

    oracle = Oracle(WHOLE)
    found["a16_candidate_monthly_sales__listed"] = (_listed_months(WHOLE), oracle.listed_months(LISTED))
    for name, text in oracle.blocks().items():
        found[name] = (_block(name, WHOLE), text)
    for name, text in oracle.records().items():
        found[f"snk7_csv_{name}"] = (_exported(name, WHOLE), text)
    loads = oracle.loads()
    for name, run in {
        "src4_backfill_status": _backfill_status,
        "snk1_loaded_rows": _loaded_rows,
        "snk1_replaced_rows": _replaced_rows,
        "str1_streamed_rows": _streamed_rows,
        "str1_split_drop": _after_streams(("1", "user_id % 2 = 0"), ("1", "user_id % 2 <> 0")),
        "str1_late_older_drop": _after_streams(("2", "true"), ("1", "user_id % 2 = 0")),
        "snk1_numeric_drops": _numeric_drops,
        "src2_array_rows": _array_rows,
        "src5_load_day": _one_day,
        "snk3_after_failed_redelivery": _redelivered(day_deliveries),
        "snk3_after_empty_redelivery": _redelivered(
            lambda spark, folder: _corrected(spark, folder).where("event_type <> 'click' and date < date'2024-01-15'")
        ),
        "snk1_quarantined_rows": _quarantined_rows,
        "snk2_published_day": lambda spark, folder: _stored(spark, _published_day(spark, folder).path),
        "snk5_published": lambda spark, folder: _published_day(spark, folder).load_range(),
        "snk6_published": lambda spark, folder: _published_day(spark, folder).rows_per_day(*EVENT_DAYS),
        "snk5_load_range": lambda spark, folder: load_range(_sales(spark, folder, WHOLE)),
        "snk6_rows_per_day": lambda spark, folder: rows_per_day(
            _sales(spark, folder, WHOLE), WHOLE.start, WHOLE.end
        ),
    }.items():
        found[name] = (run, loads[name])
    return found


def _corpus() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the corpus operators, which may be absent."""
    try:
        there = importlib.util.find_spec("cartlens.llm.queries") is not None
    except ModuleNotFoundError:
        there = False
    if not there:
        return {}, {}
    found = importlib.import_module("cartlens.llm.queries")
    runs, texts = found.queries(), found.oracle_sql()
    if importlib.util.find_spec("corpus_pipeline") is not None:
        pipeline = importlib.import_module("corpus_pipeline")
        runs["pipeline"] = pipeline.run
        if pipeline.ORACLE_SQL is not None:
            texts["pipeline"] = pipeline.ORACLE_SQL
    return runs, texts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()} | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text is not None} | _corpus()[1]
