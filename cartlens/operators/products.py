"""Per-product totals, Pareto classes and demand variability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.bands import exact
from cartlens.functions.months import month_index
from cartlens.functions.numbers import cents, money, percent
from cartlens.operators.facts import base_sales
from cartlens.operators.ordered import Size
from cartlens.operators.selection import pareto_classes
from cartlens.operators.shared import SharedSales, shared
from cartlens.params import Params
from cartlens.session import freeze

WIDE = "decimal(38,0)"


def product_totals() -> list[Column]:
    """What products sold, from sales rows."""
    quantity = F.col("quantity").cast("bigint")
    return [
        F.sum(cents(F.col("total_price"))).alias("cents"),
        F.sum(quantity).alias("units_sold"),
        F.sum(F.col("price_per_item").cast("bigint") * quantity).alias("gross_revenue"),
        F.sum(F.col("discount_per_item").cast("bigint") * quantity).alias("discount_amount"),
    ]


def product_metrics(sales: DataFrame | SharedSales, p: Params) -> DataFrame:
    """One row per product: revenue, units, gross revenue, discount, discount rate."""
    if isinstance(sales, SharedSales):
        return product_profile(sales, p).withColumn("discount_rate_pct", discount_rate())
    return (
        base_sales(sales, p)
        .groupBy("product_id")
        .agg(*product_totals())
        .withColumn("revenue", money(F.col("cents")))
        .withColumn("discount_rate_pct", discount_rate())
        .drop("cents")
    )


def discount_rate() -> Column:
    return percent(F.col("discount_amount"), F.col("gross_revenue"))


@shared
def product_months(sales: DataFrame, p: Params) -> DataFrame:
    """Totals per product and month with sales: `month` counts from the first, revenue is in cents.

    `days` has bit d set for a sale on day d of the month.
    """
    days = F.bit_or(F.expr("shiftleft(1L, day(purchase_date))")).alias("days")
    return (
        base_sales(sales, p)
        .groupBy("product_id", month_index(F.col("purchase_date"), p.first_month).alias("month"))
        .agg(*product_totals(), days)
    )


def dense_monthly_units(sales: DataFrame, p: Params) -> DataFrame:
    """Every product in every month of the period, 0 where nothing was sold.

    A product holds at most one entry per month, so filling inside the row
    needs no product x month join.
    """
    units = F.map_from_entries(F.collect_list(F.struct("month", "units_sold")))
    month = F.explode(F.sequence(F.lit(0), F.lit(p.n_months - 1)))
    return (
        product_months(sales, p)
        .groupBy("product_id")
        .agg(units.alias("units"))
        .select("product_id", "units", month.alias("month"))
        .select(
            "product_id",
            F.add_months(F.lit(p.first_month), F.col("month")).alias("month"),
            F.coalesce(F.try_element_at("units", F.col("month")), F.lit(0)).alias("units_sold"),
        )
    )


@shared
def product_profile(sales: DataFrame, p: Params) -> DataFrame:
    """Product totals plus demand variability over all months of the period.

    Months without sales add nothing to the sum of squares, so mean and
    deviation follow from the months with sales alone:
    n^2 * variance = n * sum(u^2) - sum(u)^2.
    """
    units = F.col("units_sold").cast("decimal(19,0)")
    months = F.lit(p.n_months)
    sums = product_months(sales, p).groupBy("product_id").agg(
        money(F.sum("cents")).alias("revenue"),
        F.sum("units_sold").alias("units_sold"),
        F.sum("gross_revenue").alias("gross_revenue"),
        F.sum("discount_amount").alias("discount_amount"),
        F.count_if(F.col("units_sold") > 0).alias("active_months"),
        F.sum((units * units).cast(WIDE)).alias("squares"),
    )
    return (
        sums.withColumn("square", _square(F.col("units_sold")))
        .withColumn("spread", (months * F.col("squares") - F.col("square")).cast(WIDE))
        .withColumn("avg_monthly_sales", F.col("units_sold") / F.lit(float(p.n_months)))
        .withColumn("stddev_monthly_sales", F.sqrt(F.col("spread").cast("double")) / months)
        .withColumn("variation_coef_pct", percent(F.sqrt(F.col("spread").cast("double")), F.col("units_sold")))
        .drop("squares")
    )


def _square(units: Column) -> Column:
    wide = units.cast("decimal(19,0)")
    return (wide * wide).cast(WIDE)


def cv_at_most(cut) -> Column:
    """Variation coefficient <= cut percent, compared in exact numbers."""
    return F.col("spread") * 10000 <= exact(cut) * exact(cut) * F.col("square")


def cv_at_least(cut) -> Column:
    return F.col("spread") * 10000 >= exact(cut) * exact(cut) * F.col("square")


def xyz_class(cuts) -> Column:
    x, y = cuts
    return F.when(cv_at_most(x), "X").when(cv_at_most(y), "Y").otherwise("Z")


def with_dual_class(products: DataFrame, p: Params) -> tuple[DataFrame, Size]:
    """Freeze the product table and add its revenue, units and joint class."""
    frozen = freeze(products)
    found, size = pareto_classes(frozen, ["revenue", "units_sold"], "product_id", p.abc_cuts, p.rows_per_slice)
    classes = {"revenue_class": found["revenue"], "units_class": found["units_sold"]}
    joint = F.concat("revenue_class", "units_class")
    return frozen.withColumns(classes).withColumn("abc_class", joint), size


@shared
def abc_xyz_products(sales: DataFrame, p: Params) -> DataFrame:
    """One row per product with its three-letter segment."""
    products, _ = with_dual_class(product_profile(sales, p), p)
    return products.withColumn("xyz_class", xyz_class(p.xyz_cuts)).withColumn(
        "segment", F.concat("abc_class", "xyz_class")
    )
