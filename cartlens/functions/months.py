"""Months as small integers counted from the first month of the period."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(day: Column, first_month: date) -> Column:
    """Whole months from `first_month` to the month of `day`."""
    base = first_month.year * 12 + first_month.month
    return F.year(day) * 12 + F.month(day) - F.lit(base)


def month_date(index: Column, first_month: date) -> Column:
    return F.add_months(F.lit(first_month), index)


def lowest_bit(word: str) -> str:
    """SQL for the position of the lowest set bit of a bigint expression."""
    return f"bit_count((({word}) & -({word})) - 1)"
