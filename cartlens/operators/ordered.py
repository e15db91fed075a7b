"""Results that depend on a global order, without sorting everything in one task.

The order is cut into slices by a range exchange on a unique key, so equal
values are spread too. The sliced rows are frozen first: the slice numbers are
then plain data and cannot change when a task is retried. One small table holds
what each slice adds up to; inside the slices an ordinary window does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.session import freeze

SLICES_PER_BLOCK = 1000
UPTO_HERE = (Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class Size:
    """Row count and totals of a table, known on the driver."""

    rows: int
    totals: dict = field(default_factory=dict)


def measure(frozen: DataFrame, *metrics: str) -> Size:
    row = frozen.agg(F.count("*").alias("rows"), *[F.sum(m).alias(m) for m in metrics]).first()
    return Size(row["rows"], {m: row[m] for m in metrics})


def running_sum(
    frozen: DataFrame,
    order: list[Column],
    value: Column,
    out: str,
    rows: int,
    rows_per_slice: int,
) -> DataFrame:
    """Add `out` = sum of `value` over all rows up to this one in `order`.

    `order` must be a total order. `rows` is the size of `frozen`, which is range-partitioned
    into slices of about `rows_per_slice` rows, two at least.
    """
    slices = max(2, ceil(rows / rows_per_slice))
    sliced = freeze(
        frozen.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    )
    offsets = _offsets(sliced.groupBy("_slice").agg(F.sum(value).alias("_sum")))
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(*UPTO_HERE)
    return (
        sliced.join(offsets.select("_slice", "_before"), "_slice")
        .withColumn("_inside", F.sum(value).over(inside))
        .withColumn(out, _plus(F.col("_inside"), F.col("_before")))
        .drop("_slice", "_inside", "_before")
    )


def _plus(a: Column, b: Column) -> Column:
    """The sum of what is known."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _offsets(sums: DataFrame) -> DataFrame:
    """Sums before and after each slice and after the next one, from one row per slice.

    Slices are added up in blocks, so that one task sees one row per block only.
    """
    inside = Window.partitionBy("_block").orderBy("_slice")
    blocked = sums.withColumn("_block", F.expr(f"_slice div {SLICES_PER_BLOCK}")).withColumn(
        "_place", F.row_number().over(inside)
    )
    in_order = Window.orderBy("_block")
    blocks = (
        blocked.groupBy("_block")
        .agg(F.sum("_sum").alias("_total"), F.max(F.when(F.col("_place") == 1, F.col("_sum"))).alias("_first"))
        .withColumn("_upto", F.sum("_total").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_following", F.lead("_first").over(in_order))
        .withColumn("_last_block", F.lead("_block").over(in_order).isNull())
        .select("_block", "_upto", "_following", "_last_block")
    )
    last_inside = F.lead("_slice").over(inside).isNull()
    next_sum = F.when(last_inside, F.col("_following")).otherwise(F.lead("_sum").over(inside))
    return (
        blocked.join(blocks, "_block")
        .withColumn("_next_sum", next_sum)
        .withColumn("_last", last_inside & F.col("_last_block"))
        .withColumn("_after", _plus(F.sum("_sum").over(inside.rowsBetween(*UPTO_HERE)), F.col("_upto")))
        .withColumn("_before", F.coalesce(F.lag("_after").over(inside), F.col("_upto")))
        .withColumn("_next", F.when(~F.col("_last"), F.coalesce(_plus(F.col("_after"), F.col("_next_sum")), F.lit(0))))
        .select("_slice", "_before", "_after", "_next")
    )


def largest_first(metric: str, key: str) -> list[Column]:
    return [F.col(metric).desc_nulls_first(), F.col(key).asc()]
