"""Reports that start from totals a published table keeps for each day.

The parts below hold sums, bit sets and extremes, which add up over days. A load makes them for the days it replaces only, in
the same version as the rows, so a redelivered day costs a day, and reports read neither that day's nor any other
day's rows: every block but the buyers per product (m2) and single rows starts from a part.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.months import month_index
from cartlens.operators.clients import client_totals
from cartlens.operators.facts import amount_gap, amount_totals, positive
from cartlens.operators.products import product_totals
from cartlens.operators.shared import SharedSales
from cartlens.params import Params
from cartlens.sources.published import Part, PublishedSales, Version


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def product_days(sales: DataFrame) -> DataFrame:
    """What each product sold on each day."""
    return positive(sales).groupBy("purchase_date", "product_id").agg(*product_totals())


def client_days(sales: DataFrame) -> DataFrame:
    """What each client bought on each day."""
    return positive(sales).groupBy("purchase_date", "client_id").agg(*client_totals())


def amount_days(sales: DataFrame) -> DataFrame:
    """How far the row totals of each day are off."""
    return positive(sales).withColumn("gap", amount_gap()).groupBy("purchase_date").agg(*amount_totals())


LONG = T.LongType()
PARTS = {
    "product_days": Part(
        _schema(
            product_id=LONG, cents=LONG, units_sold=LONG, gross_revenue=LONG, discount_amount=LONG, purchase_date=T.DateType()
        ),
        product_days,
    ),
    "client_days": Part(
        _schema(client_id=LONG, letter=T.IntegerType(), units=LONG, cents=LONG, purchase_date=T.DateType()),
        client_days,
    ),
    "amount_days": Part(
        _schema(
            rows_count=LONG, broken_rows=LONG, gap_cents=LONG, largest_gap=T.DecimalType(19, 2), purchase_date=T.DateType()
        ),
        amount_days,
    ),
}


def maintained_table(spark: SparkSession, path: str) -> PublishedSales:
    """A published table that keeps the parts above."""
    return PublishedSales(spark, path, PARTS)


class MaintainedSales(SharedSales):
    """One version of a published table, for a batch of reports."""

    def __init__(self, table: PublishedSales, version: Version | None = None):
        self.table, self.version = table, version or table.version()
        super().__init__(table.read(version=self.version))
        self._starts = {
            "product_months": self._product_months,
            "client_months": self._client_months,
            "amount_totals_of_period": self._amounts,
        }

    def block(self, build, p: Params, *args) -> DataFrame:
        start = self._starts.get(build.__name__)
        if start is None:
            return super().block(build, p, *args)
        key = (build.__name__, p, args)
        if key not in self._blocks:
            self._blocks[key] = self.stored(start(p, *args))
        return self._blocks[key]

    def _days(self, part: str, p: Params, end: date | None = None) -> DataFrame:
        return self.table.read(p.start, end or p.end, part, self.version)

    def _product_months(self, p: Params) -> DataFrame:
        day = F.col("purchase_date")
        sums = [F.sum(c).alias(c) for c in ("cents", "units_sold", "gross_revenue", "discount_amount")]
        days = F.bit_or(F.expr("shiftleft(1L, day(purchase_date))")).alias("days")
        return (
            self._days("product_days", p)
            .groupBy("product_id", month_index(day, p.first_month).alias("month"))
            .agg(*sums, days)
        )

    def _client_months(self, p: Params, end: date | None = None) -> DataFrame:
        day = F.col("purchase_date")
        return (
            self._days("client_days", p, end)
            .groupBy("client_id", month_index(day, p.first_month).alias("month"))
            .agg(
                F.bit_or(F.expr("shiftleft(1L, day(purchase_date))")).alias("days"),
                F.min(day).alias("first_day"),
                F.max(day).alias("last_day"),
                F.max("letter").alias("letter"),
                F.sum("units").alias("units"),
                F.sum("cents").alias("cents"),
            )
        )

    def _amounts(self, p: Params) -> DataFrame:
        return self._days("amount_days", p).agg(
            F.coalesce(F.sum("rows_count"), F.lit(0)).alias("rows_count"),
            F.coalesce(F.sum("broken_rows"), F.lit(0)).alias("broken_rows"),
            F.sum("gap_cents").alias("gap_cents"),
            F.max("largest_gap").alias("largest_gap"),
        )
