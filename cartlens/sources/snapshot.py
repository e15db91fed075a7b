"""The aggregate snapshot: one JSON document of named record lists, and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.functions.numbers import half_up, percent, ratio
from cartlens.operators.shared import SharedSales
from cartlens.params import Params
from cartlens.plans import assortment, customers, metrics

# Record lists of the snapshot and their fields. A missing value is
# unknown, not zero, and becomes an empty CSV cell.
RECORDS = {
    "assortment_actions": "group string, sku_count bigint, sku_share_pct double, "
    "revenue_share_pct double, units_share_pct double",
    "discount_actions": "group string, sku_count bigint, sku_share_pct double, revenue_share_pct double",
    "abc_revenue": "class string, sku_count bigint, sku_share_pct double, revenue_share_pct double",
    "dual_abc": "segment string, sku_count bigint, revenue double, units_sold bigint",
    "purchase_frequency": "active_days string, customer_count bigint",
    "rfm_segments": "segment string, customer_share_pct double, revenue_share_pct double",
    "repeat_rate": "window_days int, eligible_customers bigint, repeat_customers bigint, repeat_rate_pct double",
    "cohort_metrics": "month_number int, initial_customers bigint, retention_pct double, "
    "cumulative_revenue_per_original_customer double, revenue_per_active_customer double",
}
EXPORTED = (
    "assortment_actions",
    "discount_actions",
    "abc_revenue",
    "rfm_segments",
    "repeat_rate",
    "cohort_metrics",
)


def _abc_revenue(sales: DataFrame, p: Params) -> DataFrame:
    return assortment.a02_abc_summary(sales, p).selectExpr(
        "abc_class as class",
        "products_count as sku_count",
        "products_share_pct as sku_share_pct",
        "revenue_share_pct",
    )


def _dual_abc(sales: DataFrame, p: Params) -> DataFrame:
    return assortment.a04_dual_abc_summary(sales, p).selectExpr(
        "abc_class as segment", "products_count as sku_count", "revenue", "units_sold"
    )


def _purchase_frequency(sales: DataFrame, p: Params) -> DataFrame:
    return metrics.m5_frequency_tail(sales, p).selectExpr(
        "active_days", "customers_count as customer_count"
    )


def _rfm_segments(sales: DataFrame, p: Params) -> DataFrame:
    return customers.c06_rfm_segments(sales, p).selectExpr(
        "segment", "customers_share_pct as customer_share_pct", "revenue_share_pct"
    )


def _cohort_metrics(sales: DataFrame, p: Params) -> DataFrame:
    """Retention and running revenue per original client, both from one cell table."""
    return customers.fixed_cohort_curve(sales, p).select(
        "month_number",
        F.col("cohort_size").alias("initial_customers"),
        half_up(percent(F.col("active_clients"), F.col("cohort_size")), 2).alias("retention_pct"),
        half_up(ratio(F.col("cumulative"), F.col("cohort_size")), 0).alias(
            "cumulative_revenue_per_original_customer"
        ),
        half_up(ratio(F.col("revenue"), F.col("active_clients")), 0).alias("revenue_per_active_customer"),
    )


# The record lists that can be computed from sales rows.
BUILDERS = {
    "abc_revenue": _abc_revenue,
    "dual_abc": _dual_abc,
    "purchase_frequency": _purchase_frequency,
    "rfm_segments": _rfm_segments,
    "repeat_rate": customers.c13_repeat_rate,
    "cohort_metrics": _cohort_metrics,
}


def write_snapshot(sales: DataFrame | SharedSales, p: Params, path: str, names=tuple(BUILDERS)) -> None:
    """One JSON document with the named lists. Each list has a few dozen rows at most."""
    lists = []
    for name in names:
        fields = [field.strip().split(" ")[0] for field in RECORDS[name].split(",")]
        rows = BUILDERS[name](sales, p).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        lists.append(rows.scalar().alias(name))
    facts = sales.sales if isinstance(sales, SharedSales) else sales
    document = facts.sparkSession.range(1).select(*lists)
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_records(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one named list of a snapshot document."""
    schema = f"{name} array<struct<{_struct_fields(RECORDS[name])}>>"
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    return document.select(F.inline(name))


def _struct_fields(ddl: str) -> str:
    return ", ".join(":".join(field.strip().split(" ")) for field in ddl.split(","))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header line; NULL becomes an empty cell."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def export_csv(spark: SparkSession, snapshot: str, folder: str, names=EXPORTED) -> list[str]:
    """Write the named lists of a snapshot as `<folder>/<name>`; returns the paths."""
    paths = []
    for name in names:
        path = f"{folder}/{name}"
        write_csv(read_records(spark, snapshot, name).coalesce(1), path)
        paths.append(path)
    return paths
