"""Customer reports: activity, RFM, cohorts, revenue per client, repeat purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.months import month_date
from cartlens.functions.numbers import half_up, percent, ratio
from cartlens.operators.clients import client_metrics, first_two_days, rfm_scores, rfm_segments
from cartlens.operators.cohorts import activity_cells, fill_cells, observed, revenue_cells
from cartlens.operators.facts import share_of_total
from cartlens.operators.selection import quantiles
from cartlens.params import Params
from cartlens.session import freeze


def c01_customer_metrics(sales: DataFrame, p: Params) -> DataFrame:
    return (
        client_metrics(sales, p)
        .orderBy(F.col("revenue").desc_nulls_first(), "client_id")
        .select(
            "client_id",
            "gender",
            "first_purchase_date",
            "last_purchase_date",
            "active_days",
            "units_bought",
            F.col("revenue").cast("double").alias("revenue"),
        )
    )


def c02_customer_summary(sales: DataFrame, p: Params) -> DataFrame:
    clients = freeze(client_metrics(sales, p).select("client_id", "active_days", "revenue"))
    middle = quantiles(clients, "revenue", "client_id", [0.5], p.rows_per_slice).values[0]
    # Day counts have at most one distinct value per day of the period, so the
    # built-in percentile keeps a small state for them.
    return clients.agg(
        F.count("*").alias("customers_count"),
        half_up(F.avg("active_days"), 2).alias("avg_active_days"),
        half_up(F.percentile("active_days", 0.5), 2).alias("median_active_days"),
        half_up(ratio(F.sum("revenue"), F.count("revenue")), 0).alias("avg_revenue"),
    ).withColumn("median_revenue", half_up(F.lit(middle).cast("double"), 0))


def c03_rfm_percentiles(sales: DataFrame, p: Params) -> DataFrame:
    clients = freeze(client_metrics(sales, p).select("client_id", "recency_days", "active_days", "revenue"))
    steps = [0.2, 0.4, 0.6, 0.8]
    money = quantiles(clients, "revenue", "client_id", steps, p.rows_per_slice).values

    aggregates = []
    for letter, name in (("r", "recency_days"), ("f", "active_days")):
        aggregates += [F.min(name).alias(f"{letter}_min"), F.max(name).alias(f"{letter}_max")]
        aggregates.append(F.percentile(name, F.array(*map(F.lit, steps))).alias(f"{letter}_steps"))
    aggregates += [F.min("revenue").alias("m_min"), F.max("revenue").alias("m_max")]

    columns = []
    for letter in "rf":
        columns.append(F.col(f"{letter}_min"))
        columns += [
            F.col(f"{letter}_steps")[i].alias(f"{letter}_p{round(step * 100)}") for i, step in enumerate(steps)
        ]
        columns.append(F.col(f"{letter}_max"))
    columns.append(half_up(F.col("m_min"), 0).alias("m_min"))
    columns += [
        half_up(F.lit(money[i]).cast("double"), 0).alias(f"m_p{round(step * 100)}")
        for i, step in enumerate(steps)
    ]
    columns.append(half_up(F.col("m_max"), 0).alias("m_max"))
    return clients.agg(*aggregates).select(*columns)


def c04_frequency_distribution(sales: DataFrame, p: Params) -> DataFrame:
    return (
        client_metrics(sales, p)
        .groupBy(F.col("active_days").alias("frequency"))
        .agg(F.count("*").alias("customers_count"))
        .withColumn("customers_share_pct", half_up(share_of_total(F.col("customers_count")), 2))
        .orderBy("frequency")
    )


def c05_rfm_scores(sales: DataFrame, p: Params) -> DataFrame:
    scores = ["r_score", "f_score", "m_score"]
    return (
        rfm_scores(client_metrics(sales, p), p)
        .select(
            "client_id",
            "gender",
            "first_purchase_date",
            "last_purchase_date",
            "recency_days",
            F.col("active_days").alias("frequency"),
            half_up(F.col("revenue"), 0).alias("monetary"),
            *scores,
            "rfm_score",
        )
        .orderBy(*[F.col(s).desc() for s in scores], "client_id")
    )


def c06_rfm_segments(sales: DataFrame, p: Params) -> DataFrame:
    return (
        rfm_segments(client_metrics(sales, p), p)
        .groupBy("segment")
        .agg(
            F.count("*").alias("customers_count"),
            F.sum("revenue").alias("revenue"),
            F.count("revenue").alias("paying"),
            F.avg("recency_days").alias("recency"),
            F.avg("active_days").alias("frequency"),
        )
        .select(
            "segment",
            "customers_count",
            half_up(share_of_total(F.col("customers_count")), 2).alias("customers_share_pct"),
            half_up(F.col("revenue"), 0).alias("revenue"),
            half_up(share_of_total(F.col("revenue")), 2).alias("revenue_share_pct"),
            half_up(F.col("recency"), 1).alias("avg_recency_days"),
            half_up(F.col("frequency"), 2).alias("avg_frequency"),
            half_up(ratio(F.col("revenue"), F.col("paying")), 0).alias("avg_monetary"),
        )
        .orderBy(F.col("revenue").desc_nulls_first(), "segment")
    )


def _retention() -> Column:
    return half_up(percent(F.col("active_clients"), F.col("cohort_size")), 2).alias("retention_pct")


def c07_cohort_retention(sales: DataFrame, p: Params) -> DataFrame:
    """Each cohort in every month from its own start to the end of the period."""
    return (
        fill_cells(activity_cells(sales, p), observed(p), "active_clients")
        .select(
            month_date(F.col("cohort"), p.first_month).alias("cohort_month"),
            "month_number",
            "active_clients",
            "cohort_size",
            _retention(),
        )
        .orderBy("cohort_month", "month_number")
    )


def c08_retention_curve(sales: DataFrame, p: Params) -> DataFrame:
    """All cohorts that could be observed at a month_number, active or not."""
    return (
        fill_cells(activity_cells(sales, p), observed(p), "active_clients")
        .groupBy("month_number")
        .agg(
            F.sum("active_clients").alias("active_clients"),
            F.sum("cohort_size").alias("cohort_size"),
        )
        .select(
            "month_number",
            "active_clients",
            F.col("cohort_size").alias("customers_at_start"),
            _retention(),
        )
        .orderBy("month_number")
    )


def _cumulative(cells: DataFrame) -> DataFrame:
    """Running revenue inside each cohort (a cohort has one row per month at most)."""
    so_far = (
        Window.partitionBy("cohort")
        .orderBy("month_number")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return cells.withColumn("cumulative", F.sum("revenue").over(so_far))


def c09_ltv_exploration(sales: DataFrame, p: Params) -> DataFrame:
    """Cohorts change with the horizon and months without revenue are left out."""
    at_start = F.first("active_clients").over(Window.partitionBy("cohort").orderBy("month_number"))
    return (
        _cumulative(revenue_cells(sales, p).withColumn("size", at_start))
        .groupBy("month_number")
        .agg(F.sum("cumulative").alias("cumulative"), F.sum("size").alias("customers_at_start"))
        .select(
            "month_number",
            F.col("cumulative").cast("double").alias("cumulative_revenue"),
            "customers_at_start",
            half_up(ratio(F.col("cumulative"), F.col("customers_at_start")), 0).alias(
                "cumulative_revenue_per_customer"
            ),
        )
        .orderBy("month_number")
    )


def fixed_cohort_curve(sales: DataFrame, p: Params) -> DataFrame:
    """The first cohorts at every horizon, the same clients each time, gaps as zero.

    The last of them reaches its horizon before `behind`, so later months are not read.
    """
    behind = min(p.end, p.month_start(p.fixed_cohorts + p.fixed_horizon))
    cells = revenue_cells(sales, p, behind).where(F.col("cohort") < p.fixed_cohorts)
    filled = fill_cells(cells, F.lit(p.fixed_horizon), "active_clients", "revenue")
    sums = ("active_clients", "cohort_size", "revenue", "cumulative")
    return _cumulative(filled).groupBy("month_number").agg(*[F.sum(c).alias(c) for c in sums])


def c10_ltv_fixed_cohorts(sales: DataFrame, p: Params) -> DataFrame:
    """Running revenue per client of the first cohorts and its growth since M0."""
    at_m0 = F.first("each").over(Window.orderBy("month_number"))
    return (
        fixed_cohort_curve(sales, p)
        .withColumn("each", ratio(F.col("cumulative"), F.col("cohort_size")))
        .select(
            "month_number",
            half_up(F.col("cumulative"), 0).alias("cumulative_revenue"),
            F.col("cohort_size").alias("customers_count"),
            half_up(F.col("each"), 0).alias("cumulative_revenue_per_customer"),
            half_up(percent(F.col("each"), at_m0) - 100, 2).alias("growth_vs_m0_pct"),
        )
        .orderBy("month_number")
    )


def c11_retention_revenue(sales: DataFrame, p: Params) -> DataFrame:
    """Retention and revenue per original and per active client of the first cohorts."""
    return (
        fixed_cohort_curve(sales, p)
        .select(
            "month_number",
            "active_clients",
            "cohort_size",
            _retention(),
            half_up(ratio(F.col("revenue"), F.col("cohort_size")), 0).alias("revenue_per_original_customer"),
            half_up(ratio(F.col("revenue"), F.col("active_clients")), 0).alias("revenue_per_active_customer"),
        )
        .orderBy("month_number")
    )


def c12_retention_scenarios(sales: DataFrame, p: Params) -> DataFrame:
    """What the first cohorts would add if more of them came back in the next month.

    The month after a cohort counts even where it lies behind the period.
    """
    cohorts = min(p.fixed_cohorts, p.n_months)
    cells = revenue_cells(sales, p, p.month_start(cohorts + 1))
    number, active = F.col("month_number"), F.col("active_clients")
    extra = F.col("customers") * F.col("uplift") / F.lit(100.0)
    return (
        cells.where(F.col("cohort") < cohorts)
        .agg(
            F.coalesce(F.sum(F.when(number == 0, active)), F.lit(0)).alias("customers"),
            F.coalesce(F.sum(F.when(number == 1, active)), F.lit(0)).alias("active"),
            F.sum(F.when(number == 1, F.col("revenue"))).alias("revenue"),
        )
        .select(
            "customers",
            percent(F.col("active"), F.col("customers")).alias("retention"),
            ratio(F.col("revenue"), F.col("active")).alias("each"),
            F.explode(F.array(*map(F.lit, p.uplifts_pp))).alias("uplift"),
        )
        .select(
            F.col("uplift").alias("retention_uplift_pp"),
            half_up(F.col("retention"), 2).alias("baseline_retention_pct"),
            half_up(F.col("retention") + F.col("uplift"), 2).alias("scenario_retention_pct"),
            half_up(extra, 0).alias("extra_active_clients"),
            half_up(F.col("each"), 0).alias("revenue_per_active_customer"),
            half_up(extra * F.col("each"), 0).alias("incremental_revenue"),
        )
        .orderBy("retention_uplift_pp")
    )


def c13_repeat_rate(sales: DataFrame, p: Params) -> DataFrame:
    """Clients seen for a whole window, and those who bought on another day inside it."""
    first, second = F.col("first_day"), F.col("second_day")
    windows = []
    for days in p.repeat_windows:
        whole = F.date_add(first, days) < F.lit(p.end)
        back = whole & (second <= F.date_add(first, days))
        windows.append(
            F.struct(
                F.lit(days).alias("window_days"),
                F.count_if(whole).alias("eligible_customers"),
                F.count_if(back).alias("repeat_customers"),
            )
        )
    return (
        first_two_days(sales, p)
        .agg(F.array(*windows).alias("windows"))
        .select(F.inline("windows"))
        .where("eligible_customers > 0")
        .withColumn(
            "repeat_rate_pct",
            half_up(percent(F.col("repeat_customers"), F.col("eligible_customers")), 2),
        )
        .orderBy("window_days")
    )


def c14_time_to_second_day(sales: DataFrame, p: Params) -> DataFrame:
    """Days between the first two purchase days of clients who came back."""
    steps = {"p25_days": 0.25, "median_days": 0.5, "p75_days": 0.75, "p90_days": 0.9}
    days = F.datediff("second_day", "first_day")
    return (
        first_two_days(sales, p)
        .where(F.col("second_day").isNotNull())
        .select(days.alias("days"))
        .agg(
            F.count("*").alias("repeat_customers"),
            half_up(F.avg("days"), 1).alias("avg_days"),
            F.percentile("days", F.array(*map(F.lit, steps.values()))).alias("steps"),
        )
        .select(
            "repeat_customers",
            "avg_days",
            *[F.col("steps")[i].alias(name) for i, name in enumerate(steps)],
        )
    )
