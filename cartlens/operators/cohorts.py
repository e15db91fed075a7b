"""Cohort cells: cohort month x months since the first purchase.

Months are indexes from the first month of the period, so a cohort is the index
of its clients' first month and month_number is a plain difference.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.months import lowest_bit, month_index
from cartlens.functions.numbers import money
from cartlens.operators.clients import client_months
from cartlens.operators.facts import base_sales
from cartlens.operators.shared import SharedSales
from cartlens.params import Params

BITS = 63


def active_months(sales: DataFrame, p: Params) -> DataFrame:
    """`clients` per distinct set of active months, with the `cohort` (first of them).

    A client's months are the bits of a few bigints w0, w1, … Bits combine
    map-side, so one shuffle of one narrow row per client replaces the distinct,
    the join with first purchases and the distinct count.
    """
    words = _words(p)
    masks = [
        F.coalesce(
            F.bit_or(F.expr(f"case when m div {BITS} = {i} then shiftleft(1L, m % {BITS}) end")),
            F.lit(0).cast("bigint"),
        ).alias(word)
        for i, word in enumerate(words)
    ]
    lowest_bits = [
        F.when(F.col(word) != 0, i * BITS + F.expr(lowest_bit(word)))
        for i, word in enumerate(words)
    ]
    if isinstance(sales, SharedSales):
        months = client_months(sales, p).select("client_id", F.col("month").alias("m"))
    else:
        month = month_index(F.col("purchase_date"), p.first_month)
        months = base_sales(sales, p).select("client_id", month.alias("m"))
    return (
        months.groupBy("client_id")
        .agg(*masks)
        .groupBy(*words)
        .agg(F.count("*").alias("clients"))
        .withColumn("cohort", F.coalesce(*lowest_bits))
    )


def _words(p: Params) -> list[str]:
    return [f"w{i}" for i in range((p.n_months + BITS - 1) // BITS)]


def first_months(sales: DataFrame, p: Params) -> DataFrame:
    """One row per client with the first purchase day and the cohort month."""
    return (
        base_sales(sales, p)
        .groupBy("client_id")
        .agg(F.min("purchase_date").alias("first_purchase_date"))
        .withColumn("cohort_month", F.trunc("first_purchase_date", "MM"))
    )


def activity_cells(sales: DataFrame, p: Params) -> DataFrame:
    """Active clients per cohort and month_number, only where there are any."""
    word = " ".join(f"when {i} then {word}" for i, word in enumerate(_words(p)))
    bit = f"shiftright(case month div {BITS} {word} end, month % {BITS}) & 1"
    return (
        active_months(sales, p)
        .withColumn("month", F.explode(F.sequence("cohort", F.lit(p.n_months - 1))))
        .where(F.expr(bit) == 1)
        .groupBy("cohort", (F.col("month") - F.col("cohort")).alias("month_number"))
        .agg(F.sum("clients").alias("active_clients"))
    )


def revenue_cells(sales: DataFrame, p: Params, end: date | None = None) -> DataFrame:
    """Active clients and revenue per cohort and month_number, where there are any.

    Activity before `end` (a month's first day) counts. A later one than the period's lets later activity
    of clients who started inside the period count; an earlier one is for callers who need the first cohorts only.
    """
    whole_client = Window.partitionBy("client_id")
    first = F.min(F.when(F.col("first_day") < F.lit(p.end), F.col("month"))).over(whole_client)
    if end is None or end == p.end:
        months = client_months(sales, p)
    elif end < p.end and isinstance(sales, SharedSales):
        months = client_months(sales, p).where(F.col("month") < p.index_of(end))
    else:
        months = client_months(sales, p, end)
    return (
        months.withColumn("cohort", first)
        .where("cohort is not null")
        .groupBy("cohort", (F.col("month") - F.col("cohort")).alias("month_number"))
        .agg(F.count("*").alias("active_clients"), money(F.sum("cents")).alias("revenue"))
    )


def fill_cells(cells: DataFrame, last_number: Column, *values: str) -> DataFrame:
    """Every month_number 0..last_number of each cohort, zeros where nothing happened.

    Everybody in a cohort is active in its first month, so the cohort size is
    the active count at 0. A cohort has at most one cell per month: the gaps
    are filled inside one small row and no grid join is needed.
    """
    cell = F.struct(*values)
    by_number = F.map_from_entries(F.collect_list(F.struct(F.col("month_number"), cell)))
    found = F.try_element_at("cells", F.col("month_number"))
    return (
        cells.groupBy("cohort")
        .agg(by_number.alias("cells"))
        .withColumn("cohort_size", F.try_element_at("cells", F.lit(0))["active_clients"])
        .withColumn("month_number", F.explode(F.sequence(F.lit(0), last_number)))
        .select(
            "cohort",
            "month_number",
            "cohort_size",
            *[F.coalesce(found[v], F.lit(0)).alias(v) for v in values],
        )
    )


def observed(p: Params) -> Column:
    """Last month_number of a cohort that still lies in the period."""
    return F.lit(p.n_months - 1) - F.col("cohort")
