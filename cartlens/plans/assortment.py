"""Assortment reports: ABC, XYZ, their segments, discounts and review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.bands import discount_band_label, exact
from cartlens.functions.months import month_date
from cartlens.functions.numbers import correlation, half_up, money, percent, ratio
from cartlens.operators.facts import base_sales, share_of_total
from cartlens.operators.ordered import largest_first, measure, running_sum
from cartlens.operators.products import (
    abc_xyz_products,
    cv_at_least,
    discount_rate,
    product_metrics,
    product_months,
    product_profile,
    with_dual_class,
    xyz_class,
)
from cartlens.operators.selection import pareto_classes, quantiles
from cartlens.operators.shared import SharedSales
from cartlens.params import Params
from cartlens.session import freeze


def _money(name: str = "revenue") -> Column:
    return F.col(name).cast("double").alias(name)


def _count() -> Column:
    return F.count("*").alias("products_count")


def _count_share() -> Column:
    return half_up(share_of_total(F.col("products_count")), 2).alias("products_share_pct")


def _unit_price(revenue: Column, units: Column) -> Column:
    return half_up(ratio(revenue, units), 2).alias("avg_price_per_unit")


def a01_abc_product_scores(sales: DataFrame, p: Params) -> DataFrame:
    """Every product with its revenue share, running share and class, largest first."""
    products = freeze(product_metrics(sales, p).select("product_id", "revenue", "units_sold"))
    size = measure(products, "revenue")
    total = F.lit(size.totals["revenue"]).cast("double")
    order = largest_first("revenue", "product_id")
    share = F.col("revenue").cast("double") / F.nullif(total, F.lit(0.0)) * 100
    running = F.col("running").cast("double") / F.nullif(total, F.lit(0.0)) * 100
    return (
        running_sum(products, order, F.col("revenue"), "running", size.rows, p.rows_per_slice)
        .withColumn(
            "abc_class",
            _class_of_share(F.col("running"), size.totals["revenue"], p.abc_cuts),
        )
        .orderBy(*order)
        .select(
            "product_id",
            _money(),
            "units_sold",
            share.alias("revenue_share_pct"),
            running.alias("cumulative_share_pct"),
            "abc_class",
        )
    )


def _class_of_share(running: Column, total, cuts) -> Column:
    if not total:
        return F.lit("C")
    sign = 1 if total > 0 else -1
    a, b = (exact(cut) * F.lit(abs(total)) for cut in cuts)
    scaled = running * 100 * sign
    return F.when(scaled <= a, "A").when(scaled <= b, "B").otherwise("C")


def a02_abc_summary(sales: DataFrame, p: Params) -> DataFrame:
    products = freeze(product_metrics(sales, p).select("product_id", "revenue"))
    classes, _ = pareto_classes(products, ["revenue"], "product_id", p.abc_cuts, p.rows_per_slice)
    return (
        products.groupBy(classes["revenue"].alias("abc_class"))
        .agg(_count(), F.sum("revenue").alias("revenue"))
        .select(
            "abc_class",
            "products_count",
            _count_share(),
            half_up(F.col("revenue"), 0).alias("revenue"),
            half_up(share_of_total(F.col("revenue")), 2).alias("revenue_share_pct"),
        )
        .orderBy("abc_class")
    )


def _dual(sales: DataFrame, p: Params) -> DataFrame:
    products, _ = with_dual_class(
        product_metrics(sales, p).select("product_id", "revenue", "units_sold"), p
    )
    return products


def a03_dual_abc_scores(sales: DataFrame, p: Params) -> DataFrame:
    return (
        _dual(sales, p)
        .orderBy(*largest_first("revenue", "product_id"))
        .select("product_id", _money(), "units_sold", "revenue_class", "units_class", "abc_class")
    )


def a04_dual_abc_summary(sales: DataFrame, p: Params) -> DataFrame:
    return (
        _dual(sales, p)
        .groupBy("abc_class")
        .agg(_count(), F.sum("revenue").alias("revenue"), F.sum("units_sold").alias("units_sold"))
        .select(
            "abc_class",
            "products_count",
            _count_share(),
            half_up(F.col("revenue"), 0).alias("revenue"),
            "units_sold",
        )
        .orderBy("abc_class")
    )


def a05_abc_price_comparison(sales: DataFrame, p: Params) -> DataFrame:
    """Mean revenue and units of a product, and the units-weighted price."""
    revenue, units = F.sum("revenue"), F.sum("units_sold")
    return (
        _dual(sales, p)
        .groupBy("abc_class")
        .agg(
            _count(),
            half_up(ratio(revenue, F.count("revenue")), 0).alias("avg_revenue_per_product"),
            half_up(ratio(units, F.count("units_sold")), 1).alias("avg_units_per_product"),
            _unit_price(revenue, units),
        )
        .orderBy("abc_class")
    )


def a06_xyz_product_scores(sales: DataFrame, p: Params) -> DataFrame:
    rounded = [
        half_up(F.col(name), 2).alias(name)
        for name in ("avg_monthly_sales", "stddev_monthly_sales", "variation_coef_pct")
    ]
    return (
        product_profile(sales, p)
        .select("product_id", *rounded, xyz_class(p.xyz_cuts).alias("xyz_class"))
        .orderBy(F.col("variation_coef_pct").asc_nulls_last(), "product_id")
    )


def _xyz_summary(sales: DataFrame, p: Params, cuts) -> DataFrame:
    return (
        product_profile(sales, p)
        .groupBy(xyz_class(cuts).alias("xyz_class"))
        .agg(_count(), F.avg("variation_coef_pct").alias("cv"))
        .select(
            "xyz_class",
            "products_count",
            _count_share(),
            half_up(F.col("cv"), 2).alias("avg_variation_coef_pct"),
        )
        .orderBy("xyz_class")
    )


def a07_xyz_classic_summary(sales: DataFrame, p: Params) -> DataFrame:
    return _xyz_summary(sales, p, p.xyz_classic_cuts)


def a08_cv_distribution(sales: DataFrame, p: Params) -> DataFrame:
    """Lowest, highest and interpolated percentiles of the variation coefficient."""
    names = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}
    products = freeze(product_profile(sales, p).select("product_id", "variation_coef_pct"))
    found = quantiles(products, "variation_coef_pct", "product_id", names.values(), p.rows_per_slice)
    columns = {"min_cv": found.low, **dict(zip(names, found.values)), "max_cv": found.high}
    one = products.sparkSession.range(1)
    return one.select(*[half_up(F.lit(value).cast("double"), 2).alias(name) for name, value in columns.items()])


def a09_xyz_adapted_summary(sales: DataFrame, p: Params) -> DataFrame:
    return _xyz_summary(sales, p, p.xyz_cuts)


def a10_abc_xyz_segments(sales: DataFrame, p: Params) -> DataFrame:
    return (
        abc_xyz_products(sales, p)
        .groupBy("segment")
        .agg(
            _count(),
            F.sum("revenue").alias("revenue"),
            F.sum("units_sold").alias("units_sold"),
            F.avg("variation_coef_pct").alias("cv"),
        )
        .select(
            "segment",
            "products_count",
            _count_share(),
            half_up(F.col("revenue"), 0).alias("revenue"),
            "units_sold",
            _unit_price(F.col("revenue"), F.col("units_sold")),
            half_up(F.col("cv"), 2).alias("avg_cv_pct"),
        )
        .orderBy("segment")
    )


def a11_segment_discounts(sales: DataFrame, p: Params) -> DataFrame:
    """Discounts of a segment weighted by what was sold."""
    revenue, units = F.sum("revenue"), F.sum("units_sold")
    return (
        abc_xyz_products(sales, p)
        .groupBy("segment")
        .agg(
            _count(),
            half_up(percent(F.sum("discount_amount"), F.sum("gross_revenue")), 2).alias("discount_rate_pct"),
            _unit_price(revenue, units),
            half_up(revenue, 0).alias("revenue"),
            units.alias("units_sold"),
        )
        .orderBy("segment")
    )


def a12_discount_bands(sales: DataFrame, p: Params) -> DataFrame:
    """Products per band of their weighted discount; unknown rates form the last band."""
    width = p.discount_band
    lower = F.floor(F.col("discount_rate_pct") / width) * width
    return (
        product_metrics(sales, p)
        .groupBy(lower.alias("lower"))
        .agg(_count(), half_up(ratio(F.sum("units_sold"), F.count("units_sold")), 1).alias("avg_units_sold"))
        .orderBy(F.col("lower").asc_nulls_last())
        .select(
            discount_band_label(F.col("lower"), width).alias("discount_group"),
            "products_count",
            "avg_units_sold",
        )
    )


def a13_discount_correlation(sales: DataFrame, p: Params) -> DataFrame:
    rate = F.col("discount_rate_pct")
    return (
        abc_xyz_products(sales, p)
        .withColumn("discount_rate_pct", discount_rate())
        .groupBy("segment")
        .agg(
            _count(),
            half_up(F.avg(rate), 2).alias("avg_discount_pct"),
            half_up(correlation(rate, F.col("units_sold")), 4).alias("discount_sales_correlation"),
        )
        .orderBy("segment")
    )


def _review(sales: DataFrame, p: Params) -> DataFrame:
    return abc_xyz_products(sales, p).where(F.col("segment") == p.review_segment)


def _review_columns() -> list:
    return [
        "product_id",
        half_up(F.col("revenue"), 0).alias("revenue"),
        "units_sold",
        "active_months",
        half_up(F.col("avg_monthly_sales"), 1).alias("avg_monthly_sales"),
        half_up(F.col("variation_coef_pct"), 2).alias("cv_pct"),
        _unit_price(F.col("revenue"), F.col("units_sold")),
        half_up(discount_rate(), 2).alias("discount_rate_pct"),
    ]


def a14_ccz_review(sales: DataFrame, p: Params) -> DataFrame:
    smallest = [F.col(c).asc_nulls_last() for c in ("revenue", "units_sold", "active_months")]
    return _review(sales, p).select(*_review_columns()).orderBy(*smallest, "product_id")


def _candidates(sales: DataFrame, p: Params) -> DataFrame:
    return _review(sales, p).where(
        (F.col("revenue") <= exact(p.review_max_revenue))
        & (F.col("units_sold") <= p.review_max_units)
        & cv_at_least(p.review_min_cv)
    )


def a15_ccz_priority_candidates(sales: DataFrame, p: Params) -> DataFrame:
    """Review products inside the fixed bounds, which are inclusive and unrounded."""
    return (
        _candidates(sales, p)
        .select(*_review_columns())
        .orderBy(F.col("revenue").asc_nulls_last(), "product_id")
    )


def candidate_months(sales: DataFrame | SharedSales, p: Params) -> DataFrame:
    """`a16_candidate_monthly_sales` of the candidates of `a15_ccz_priority_candidates`, both from one table of product months."""
    sales = sales if isinstance(sales, SharedSales) else SharedSales(sales)
    return a16_candidate_monthly_sales(sales, p, _candidates(sales, p))


def a16_candidate_monthly_sales(
    sales: DataFrame, p: Params, products: DataFrame | None = None
) -> DataFrame:
    """Months with sales of the listed products, or of those in `products`."""
    months = product_months(sales, p)
    if products is None:
        months = months.where(F.col("product_id").isin(*p.candidate_ids))
    else:
        months = months.join(products.select("product_id").distinct(), "product_id", "left_semi")
    return months.select(
        "product_id",
        month_date(F.col("month"), p.first_month).alias("month"),
        "units_sold",
        half_up(money(F.col("cents")), 0).alias("revenue"),
    ).orderBy("product_id", "month")
