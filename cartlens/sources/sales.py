"""Ways to get a `sales` DataFrame, and to store one."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.sources.published import PublishedSales, sales_files
from cartlens.sources.schema import SALES

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz"
LINES = "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double"


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """The stored table: parquet in one folder per purchase_date, or the last version of a published one."""
    if PublishedSales.exists(spark, path):
        return PublishedSales(spark, path).read()
    return spark.read.schema(SALES).parquet(path)


def write_sales(sales: DataFrame, path: str) -> None:
    """Replace exactly the days that occur in `sales` and leave all others alone.

    The rebalance hint lets adaptive execution cut a very large day into several
    files and merge small ones.
    """
    writer = sales_files(sales.select(*SALES.names).hint("rebalance", "purchase_date"))
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_range(sales: DataFrame) -> DataFrame:
    """First day, last day and row count of a loaded table."""
    return sales.agg(
        F.min("purchase_date").alias("min_date"),
        F.max("purchase_date").alias("max_date"),
        F.count("*").alias("rows_count"),
    )


def rows_per_day(sales: DataFrame, start: date, end: date) -> DataFrame:
    day = F.col("purchase_date")
    return (
        sales.where((day >= F.lit(start)) & (day < F.lit(end)))
        .groupBy("purchase_date")
        .agg(F.count("*").alias("rows_count"))
        .orderBy("purchase_date")
    )


def sales_from_order_lines(
    spark: SparkSession,
    folder: str,
    start: date | None = None,
    end: date | None = None,
    billed: bool = False,
) -> DataFrame:
    """The order-line tables `lineitem` and `orders` seen as sales rows.

    Prices are whole money, the discount is rounded to whole money, and the row
    total follows from both; with `billed` it is the rounded line amount
    instead. The order status stands in for the one-letter client attribute.
    """
    orders = spark.read.schema(ORDERS).parquet(f"{folder}/orders.parquet")
    lines = spark.read.schema(LINES).parquet(f"{folder}/lineitem.parquet")
    ordered = F.col("o_orderdate")
    if start is not None:
        orders = orders.where(ordered >= _midnight(start))
    if end is not None:
        orders = orders.where(ordered < _midnight(end))

    # Amounts are not negative, so adding a half and cutting rounds half away from zero.
    priced = lines.selectExpr(
        "l_orderkey as o_orderkey",
        "l_partkey as product_id",
        "cast(l_quantity as int) as quantity",
        "floor(l_extendedprice / l_quantity + 0.5D) as price_per_item",
        "floor(l_discount * 100 + 0.5D) as percent",
        "l_extendedprice * (1 - l_discount) as amount",
    ).selectExpr("*", "(price_per_item * percent + 50) div 100 as discount_per_item")
    if billed:
        total = "round(cast(amount as decimal(18,8)), 2)"
    else:
        total = "(price_per_item - discount_per_item) * quantity"
    return priced.join(orders, "o_orderkey").selectExpr(
        "o_custkey as client_id",
        "o_orderstatus as gender",
        "cast(o_orderdate as date) as purchase_date",
        "0 as purchase_time_as_seconds_from_midnight",
        "product_id",
        "quantity",
        "price_per_item",
        "discount_per_item",
        f"cast({total} as decimal(18,2)) as total_price",
    )


def _midnight(day: date) -> Column:
    """A timestamp without zone, as the order tables store it, so the bound is pushed down."""
    return F.lit(datetime.combine(day, time())).cast("timestamp_ntz")

