"""The rows every query starts from, and shares on small results."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.numbers import cents, percent
from cartlens.operators.shared import SharedSales
from cartlens.params import Params


def base_sales(sales: DataFrame | SharedSales, p: Params, end: date | None = None) -> DataFrame:
    """Positive quantities inside the half-open period."""
    if isinstance(sales, SharedSales):
        sales = sales.sales
    day = F.col("purchase_date")
    return positive(sales).where((day >= F.lit(p.start)) & (day < F.lit(end or p.end)))


def positive(sales: DataFrame) -> DataFrame:
    """Positive quantities, whatever the day."""
    return sales.where(F.col("quantity") > 0).withColumn("total_price", F.col("total_price").cast("decimal(18,2)"))


def amount_gap() -> Column:
    """What a row's total is above (price - discount) * quantity."""
    expected = (F.col("price_per_item") - F.col("discount_per_item")) * F.col("quantity")
    return F.col("total_price").cast("decimal(18,2)") - expected.cast("decimal(18,2)")


def amount_totals() -> list[Column]:
    """Rows, rows with another total than expected, and by how much, from a column `gap`."""
    return [
        F.count("*").alias("rows_count"),
        F.count_if((F.col("gap") != 0) | F.col("gap").isNull()).alias("broken_rows"),
        F.sum(cents(F.abs("gap"))).alias("gap_cents"),
        F.max(F.abs("gap")).alias("largest_gap"),
    ]


def share_of_total(value: Column) -> Column:
    """100 * value / total of the result. Only for results of bounded size."""
    everything = Window.partitionBy()
    return percent(value, F.sum(value).over(everything))
