"""Rounding, ratios and money sums with one meaning in every query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,2)"


def half_up(value: Column, digits: int) -> Column:
    """Round half away from zero at `digits` decimals.

    Going through a decimal keeps 142.5 -> 143 and 1.005 -> 1.01, which binary
    rounding would get wrong.
    """
    return F.round(value.cast("decimal(38,8)"), digits).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in double; NULL where the denominator is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def cents(amount: Column) -> Column:
    """A decimal(18,2) amount as whole cents.

    Sums of a bigint stay in generated code with a fixed-width buffer, which
    decimal sums do not; an overflow raises instead of wrapping.
    """
    return (amount * 100).cast("bigint")


def money(whole_cents: Column) -> Column:
    return (whole_cents.cast("decimal(20,0)") / 100).cast(MONEY)


def sum_money(amount: Column) -> Column:
    """Exact sum of a decimal(18,2) column."""
    return money(F.sum(cents(amount)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of a group; NULL for one row or a constant side."""
    x, y = x.cast("double"), y.cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
