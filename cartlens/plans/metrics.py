"""Figures the study quotes in its text, built from the same blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.numbers import correlation, half_up, money, percent
from cartlens.operators.clients import client_metrics
from cartlens.operators.facts import amount_gap, amount_totals, base_sales, share_of_total
from cartlens.operators.products import abc_xyz_products, product_metrics, product_months, with_dual_class
from cartlens.operators.shared import shared
from cartlens.params import Params


def m1_amount_check(sales: DataFrame, p: Params) -> DataFrame:
    """How many rows break total = (price - discount) * quantity, and by how much."""
    return amount_totals_of_period(sales, p).select(
        "rows_count",
        "broken_rows",
        half_up(money(F.col("gap_cents")), 2).alias("total_gap"),
        F.col("largest_gap").cast("double").alias("largest_gap"),
    )


@shared
def amount_totals_of_period(sales: DataFrame, p: Params) -> DataFrame:
    return base_sales(sales, p).withColumn("gap", amount_gap()).agg(*amount_totals())


def m1_broken_rows(sales: DataFrame, p: Params) -> DataFrame:
    """The rows counted by `m1_amount_check`."""
    return base_sales(sales, p).where((amount_gap() != 0) | amount_gap().isNull())


def m2_product_reach(sales: DataFrame, p: Params) -> DataFrame:
    """Buyers and days with sales per product.

    Days are bits of the product's months. Buyers are bits too: each 64 neighbouring client ids are a word per product, which
    combines map-side like a sum, so a task sends at most one row for each product and word, however often its clients bought.
    """
    word = F.expr("shiftright(client_id, 6)").alias("word")
    bits = F.bit_or(F.expr("shiftleft(1L, cast(client_id & 63 as int))")).alias("bits")
    words = base_sales(sales, p).where("client_id is not null").groupBy("product_id", word).agg(bits)
    buyers = words.groupBy("product_id").agg(F.sum(F.bit_count("bits")).alias("buyers"))
    days = product_months(sales, p).groupBy("product_id").agg(F.sum(F.bit_count("days")).alias("active_days"))
    return (
        days.join(buyers, days["product_id"].eqNullSafe(buyers["product_id"]), "left")
        .select(days["product_id"], F.coalesce("buyers", F.lit(0)).alias("buyers"), "active_days")
        .orderBy("product_id")
    )


def m3_discount_units_correlation(sales: DataFrame, p: Params) -> DataFrame:
    rate, units = F.col("discount_rate_pct"), F.col("units_sold")
    return product_metrics(sales, p).agg(
        F.count("*").alias("products_count"),
        half_up(correlation(rate, units), 4).alias("discount_sales_correlation"),
    )


def m4_core_split(sales: DataFrame, p: Params) -> DataFrame:
    """The AA products, steady (X, Y) against volatile (Z), with their share of everything."""
    products = abc_xyz_products(sales, p)
    core = F.when(F.col("abc_class") != "AA", "rest").when(F.col("xyz_class") == "Z", "AAZ").otherwise("AAX+AAY")
    return (
        products.groupBy(core.alias("core"))
        .agg(
            F.count("*").alias("products_count"),
            F.sum("revenue").alias("revenue"),
            F.sum("units_sold").alias("units"),
        )
        .select(
            "core",
            "products_count",
            half_up(share_of_total(F.col("revenue")), 2).alias("revenue_share_pct"),
            half_up(share_of_total(F.col("units")), 2).alias("units_share_pct"),
        )
        .where("core <> 'rest'")
        .orderBy("core")
    )


def m5_frequency_tail(sales: DataFrame, p: Params, tail: int = 9) -> DataFrame:
    """Clients per number of purchase days, `tail` and more in one group."""
    days = F.least("active_days", F.lit(tail)).cast("int")
    label = F.concat(F.col("days").cast("string"), F.when(F.col("days") == tail, "+").otherwise(""))
    return (
        client_metrics(sales, p)
        .groupBy(days.alias("days"))
        .agg(F.count("*").alias("customers_count"))
        .withColumn("customers_share_pct", half_up(share_of_total(F.col("customers_count")), 2))
        .orderBy("days")
        .select(label.alias("active_days"), "customers_count", "customers_share_pct")
    )


def m6_dual_abc_shares(sales: DataFrame, p: Params) -> DataFrame:
    """Share of products, revenue and units of each joint class."""
    products, size = with_dual_class(
        product_metrics(sales, p).select("product_id", "revenue", "units_sold"), p
    )
    return (
        products.groupBy("abc_class")
        .agg(
            F.count("*").alias("products_count"),
            F.sum("revenue").alias("revenue"),
            F.sum("units_sold").alias("units"),
        )
        .select(
            "abc_class",
            "products_count",
            half_up(percent(F.col("products_count"), F.lit(size.rows)), 2).alias("products_share_pct"),
            half_up(percent(F.col("revenue"), F.lit(size.totals["revenue"])), 2).alias("revenue_share_pct"),
            half_up(percent(F.col("units"), F.lit(size.totals["units_sold"])), 2).alias("units_share_pct"),
        )
        .orderBy("abc_class")
    )
