"""Places in a global order, found without sorting it: Pareto cuts and percentiles by refined histograms.

A place is the last row, in the order of (value, key), up to which the weights add up to no more than a bound. One aggregate puts all
values of a table into bins that keep their order, with exact sums for each bin, so the bin with the place is known. If it has
few rows, these alone are ordered; else it is cut into finer bins, by value, or by key where one value fills it, and so on. Nothing but
bins and the rows of one bin for each place moves. The number of bins is bounded by the range of the values: BINS_PER_E for each
factor e, about 8,300 for numbers of 28 digits, and FINER for each refinement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cartlens.operators.ordered import UPTO_HERE, Size

BINS_PER_E = 64
FINER = 4096


@dataclass(frozen=True)
class Order:
    """Rows in ascending order of (value, key), each with a weight. Rows without a value stand outside."""

    value: Column
    key: str
    weight: Column


@dataclass(frozen=True)
class Place:
    """Rows up to `value` are inside; of rows with that value, if `by_key`, those up to `key`."""

    value: object = None
    key: object = None
    by_key: bool = False


def _bin(value: Column) -> Column:
    """A small number that grows with the value."""
    number = value.cast("double")
    return (F.signum(number) * F.ceil(F.ln(F.abs(number) + 1) * BINS_PER_E)).cast("int")


def _finer(value: Column, low, high) -> Column:
    """FINER bins between two values."""
    return F.floor((value - F.lit(low)).cast("double") / F.lit(float(high - low)) * (FINER - 1)).cast("int")


def _counted(rows: DataFrame, order: Order, bins: Column) -> DataFrame:
    key = F.col(order.key)
    return rows.groupBy(bins.alias("bin")).agg(
        F.count("*").alias("n"),
        F.sum(order.weight).alias("total"),
        F.min(order.value).alias("low"),
        F.max(order.value).alias("high"),
        F.min(key).alias("first"),
        F.max(key).alias("last"),
    )


def histograms(rows: DataFrame, orders: dict[str, Order]) -> tuple[int, dict[str, list[Row]]]:
    """The number of rows, and the bins of every order, in one job."""
    parts = []
    for name, order in orders.items():
        found = _counted(rows, order, _bin(order.value))
        # Orders of different types stand in columns of their own.
        parts.append(found.select(F.lit(name).alias("order"), "bin", "n", F.struct("total", "low", "high", "first", "last").alias(name)))
    bins = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).collect()
    found = {name: [] for name in orders}
    for row in bins:
        found[row["order"]].append(Row(bin=row["bin"], n=row["n"], **row[row["order"]].asDict()))
    for name in found:
        found[name].sort(key=lambda b: (b["bin"] is not None, b["bin"] or 0))
    count = sum(b["n"] for b in next(iter(found.values())))
    return count, {name: [b for b in own if b["bin"] is not None] for name, own in found.items()}


@dataclass
class _Search:
    order: Order
    bins: list[Row]
    factor: int
    bound: object
    before: object = 0
    by_key: bool = False
    #: The bin whose rows are to be ordered, once it has few, and the end of what stands before it.
    last: Row | None = None
    reached: Place = Place()
    place: Place | None = None

    def step(self, limit: int) -> Callable | None:
        """Settle for a bin, or return the rows and bins of the next histogram."""
        sums, chosen = [self.before], None
        for k, b in enumerate(self.bins):
            sums.append(sums[-1] + (b["total"] or 0))
            if min(sums[-2] * self.factor, sums[-1] * self.factor) <= self.bound:
                chosen = k
        if chosen is None:
            self.place = self.reached
            return None
        b = self.bins[chosen]
        if chosen:
            end = self.bins[chosen - 1]
            self.reached = Place(end["high"], end["last"], self.by_key)
        if sums[chosen + 1] * self.factor <= self.bound:
            self.place = Place(b["high"], b["last"], self.by_key)
            return None
        self.before = sums[chosen]
        if b["n"] <= limit or b["low"] == b["high"] and b["first"] == b["last"]:
            self.last = b
            return None
        if b["low"] < b["high"]:
            inside = self.order.value.between(F.lit(b["low"]), F.lit(b["high"]))
            return lambda rows: _counted(rows.where(inside), self.order, _finer(self.order.value, b["low"], b["high"]))
        key, inside = F.col(self.order.key), self._inside(b)
        self.by_key = True
        return lambda rows: _counted(
            rows.where(inside), self.order, F.coalesce(_finer(key, b["first"], b["last"]), F.lit(-1)) if b["first"] is not None else F.lit(0)
        )

    def _inside(self, b: Row) -> Column:
        inside = self.order.value.between(F.lit(b["low"]), F.lit(b["high"]))
        if self.by_key and b["first"] is not None:
            inside = inside & F.col(self.order.key).between(F.lit(b["first"]), F.lit(b["last"]))
        elif self.by_key:
            inside = inside & F.col(self.order.key).isNull()
        return inside

    def ordered(self, rows: DataFrame, number: int) -> DataFrame:
        """The rows of the last bin with the sum of the weights up to each."""
        upto = Window.partitionBy("search").orderBy("value", "key").rowsBetween(*UPTO_HERE)
        return (
            rows.where(self._inside(self.last))
            .select(F.lit(number).alias("search"), self.order.value.alias("value"), F.col(self.order.key).alias("key"), self.order.weight.alias("w"))
            .withColumn("upto", F.sum("w").over(upto))
            .where((F.col("upto") + F.lit(self.before)) * self.factor <= F.lit(self.bound))
            .groupBy("search")
            .agg(F.max(F.struct("value", "key")).alias(f"place{number}"))
        )


def places(rows: DataFrame, searches: list[tuple[Order, list[Row], int, object]], limit: int) -> list[Place]:
    """For every (order, its bins, factor, bound): the last row with factor * running weight <= bound."""
    found = [_Search(*search) for search in searches]
    for search in found:
        while (finer := search.step(limit)) is not None:
            search.bins = sorted(finer(rows).collect(), key=lambda b: b["bin"])
    open_ = [(k, s) for k, s in enumerate(found) if s.place is None]
    if open_:
        parts = [s.ordered(rows, k) for k, s in open_]
        done = {r["search"]: r[f"place{r['search']}"] for r in reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).collect()}
        for k, s in open_:
            s.place = Place(*done[k], by_key=True) if k in done else s.reached
    return [s.place for s in found]


def _upto(order: Order, place: Place) -> Column:
    """Whether a row stands inside."""
    if place.value is None:
        return F.lit(False)
    value, bound = order.value, F.lit(place.value)
    if not place.by_key:
        return value <= bound
    # Without a key comes first.
    key = F.col(order.key)
    inside = key.isNull() if place.key is None else key.isNull() | (key <= F.lit(place.key))
    return (value < bound) | (value == bound) & inside


def pareto_classes(frozen: DataFrame, metrics: list[str], key: str, cuts, limit: int) -> tuple[dict[str, Column], Size]:
    """A/B/C for every metric by the inclusive running share, largest first, and what all rows add up to.

    Classes are consecutive stretches of the order, so the last item of each is enough to classify every row without
    moving it. The shares are compared exactly, as running * 100 <= cut * total. A row without the metric is in the last class.
    """
    labels = "ABC"
    orders = {m: Order(-F.col(m), key, F.col(m)) for m in metrics}
    rows, bins = histograms(frozen, orders)
    totals = {m: sum(b["total"] for b in bins[m]) if bins[m] else None for m in metrics}
    searches = []
    for m in metrics:
        if totals[m]:
            sign = 1 if totals[m] > 0 else -1
            searches += [(orders[m], bins[m], 100 * sign, Decimal(str(cut)) * abs(Decimal(totals[m]))) for cut in cuts]
    found = iter(places(frozen, searches, limit))
    classes = {}
    for m in metrics:
        out = F.when(F.col(m).isNull(), F.lit(labels[-1]))
        if totals[m]:
            for label, _ in zip(labels, cuts):
                out = out.when(_upto(orders[m], next(found)), F.lit(label))
        classes[m] = out.otherwise(F.lit(labels[-1]))
    return classes, Size(rows, totals)


@dataclass(frozen=True)
class Quantiles:
    """How many values there are, the ends, and the interpolated percentiles asked for."""

    n: int
    low: float | None
    high: float | None
    values: list


def quantiles(frozen: DataFrame, value: str, key: str, probabilities, limit: int) -> Quantiles:
    """Exact, linearly interpolated percentiles of values with unboundedly many distinct numbers."""
    order = Order(F.col(value), key, F.lit(1).cast("bigint"))
    _, bins = histograms(frozen, {"values": order})
    own = bins["values"]
    n = sum(b["n"] for b in own)
    if not n:
        return Quantiles(0, None, None, [None for _ in probabilities])
    at = [p * (n - 1) for p in probabilities]
    ranks = sorted({edge + 1 for place in at for edge in (floor(place), ceil(place))})
    known, upto = {}, 0
    for b in own:
        # A bin of one value needs no search.
        known |= {rank: b["low"] for rank in ranks if upto < rank <= upto + b["n"] and b["low"] == b["high"]}
        upto += b["n"]
    open_ = [rank for rank in ranks if rank not in known]
    for rank, place in zip(open_, places(frozen, [(order, own, 1, rank) for rank in open_], limit)):
        known[rank] = place.value
    values = []
    for place in at:
        low, high = float(known[floor(place) + 1]), float(known[ceil(place) + 1])
        values.append(low + (high - low) * (place - floor(place)))
    return Quantiles(n, float(own[0]["low"]), float(own[-1]["high"]), values)
