"""Per-client activity, scores and purchase days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.bands import band, rfm_segment
from cartlens.functions.months import lowest_bit, month_index
from cartlens.functions.numbers import cents, money
from cartlens.operators.facts import base_sales
from cartlens.operators.shared import shared
from cartlens.params import Params


@shared
def client_months(sales: DataFrame, p: Params, end: date | None = None) -> DataFrame:
    """One row per client and month with purchases; every client report can start here.

    `days` has bit d set for a purchase on day d of the month. Distinct days
    thus combine map-side like a sum, and a client never has more rows than the
    period has months.
    """
    day = F.col("purchase_date")
    return (
        base_sales(sales, p, end)
        .groupBy("client_id", month_index(day, p.first_month).alias("month"))
        .agg(
            F.bit_or(F.expr("shiftleft(1L, day(purchase_date))")).alias("days"),
            F.min(day).alias("first_day"),
            F.max(day).alias("last_day"),
            *client_totals(),
        )
    )


def client_totals() -> list[Column]:
    """What clients bought, and the code point of their letter, from sales rows."""
    too_long = F.raise_error(F.concat(F.lit("gender has more than one letter: "), "gender")).cast("int")
    return [
        F.max(F.when(F.length("gender") > 1, too_long).otherwise(F.ascii("gender"))).alias("letter"),
        F.sum(F.col("quantity").cast("bigint")).alias("units"),
        F.sum(cents(F.col("total_price"))).alias("cents"),
    ]


def client_metrics(sales: DataFrame, p: Params) -> DataFrame:
    """One row per client: gender, first and last day, active days, units, revenue, recency."""
    return (
        client_months(sales, p)
        .groupBy("client_id")
        .agg(
            _letter(F.max("letter")).alias("gender"),
            F.min("first_day").alias("first_purchase_date"),
            F.max("last_day").alias("last_purchase_date"),
            F.sum(F.bit_count("days")).alias("active_days"),
            F.sum("units").alias("units_bought"),
            money(F.sum("cents")).alias("revenue"),
        )
        .withColumn("recency_days", F.datediff(F.lit(p.end), F.col("last_purchase_date")))
    )


def _letter(code: Column) -> Column:
    """The one-letter text of a code point, '' for 0.

    The largest letter is found through its code point, because a text maximum
    would turn the hash aggregation of all rows into a sort.
    """
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(code == 0, "").otherwise(F.decode(utf32, "UTF-32"))


def rfm_scores(clients: DataFrame, p: Params) -> DataFrame:
    """Scores 1..5 by fixed bounds; recent, frequent and valuable clients score high."""
    return clients.withColumns(
        {
            "r_score": band(F.col("recency_days"), p.recency_cuts, (5, 4, 3, 2, 1)),
            "f_score": band(F.col("active_days"), p.frequency_cuts, (1, 2, 3, 4, 5)),
            "m_score": band(F.col("revenue"), p.monetary_cuts, (1, 2, 3, 4, 5)),
        }
    ).withColumn("rfm_score", F.concat_ws("", "r_score", "f_score", "m_score"))


def rfm_segments(clients: DataFrame, p: Params) -> DataFrame:
    scores = [F.col(name) for name in ("r_score", "f_score", "m_score")]
    return rfm_scores(clients, p).withColumn("segment", rfm_segment(*scores, p.segment_language))


def purchase_days(sales: DataFrame, p: Params) -> DataFrame:
    return base_sales(sales, p).select("client_id", "purchase_date").distinct()


def first_two_days(sales: DataFrame, p: Params) -> DataFrame:
    """First and second purchase day per client (second is NULL for one-day clients).

    The second day lies in the first month, or it is the first day of the second
    month. The rank filter runs before the shuffle as well, so at most two
    months of a client leave each task.
    """
    by_month = Window.partitionBy("client_id").orderBy("month")
    later_bits = "days & (days - 1)"
    next_day = F.expr(
        f"if({later_bits} = 0, null, date_add(trunc(first_day, 'MM'), {lowest_bit(later_bits)} - 1))"
    )
    second = F.when(F.col("nth") == 1, next_day).otherwise(F.col("first_day"))
    return (
        client_months(sales, p)
        .withColumn("nth", F.row_number().over(by_month))
        .where("nth <= 2")
        .groupBy("client_id")
        .agg(F.min("first_day").alias("first_day"), F.min(second).alias("second_day"))
    )
