"""Assortment reports on small frames and against straightforward computations."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from dataclasses import replace
from datetime import date
from decimal import Decimal
from statistics import mean, pstdev

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cartlens import Params
from cartlens.operators import ordered
from cartlens.operators.ordered import largest_first, running_sum
from cartlens.operators.selection import pareto_classes, quantiles
from cartlens.operators.products import dense_monthly_units, product_profile
from cartlens.plans import assortment as a
from cartlens.plans import metrics as m
from pyspark.sql import functions as F

P = Params()


def line(product, total, quantity=1, day="2023-03-05", price=None, discount=0, client=1):
    return {"client_id": client, "product_id": product, "purchase_date": day, "quantity": quantity,
            "price_per_item": int(float(total)) if price is None else price, "discount_per_item": discount,
            "total_price": total}


def classes(frame, name="abc_class"):
    return {r["product_id"]: r[name] for r in frame.collect()}


def brute_classes(revenue: dict, cuts=(80, 95)) -> dict:
    total, running, out = sum(revenue.values()), 0, {}
    for product, value in sorted(revenue.items(), key=lambda kv: (-kv[1], kv[0])):
        running += value
        out[product] = "A" if running * 100 <= cuts[0] * total else "B" if running * 100 <= cuts[1] * total else "C"
    return out


def test_product_that_crosses_a_cut_gets_the_next_class(make_sales):
    sales = make_sales([line(1, 960), line(2, 30), line(3, 10)])
    assert classes(a.a01_abc_product_scores(sales, P)) == {1: "C", 2: "C", 3: "C"}
    assert classes(a.a03_dual_abc_scores(sales, P), "revenue_class") == {1: "C", 2: "C", 3: "C"}


def test_share_exactly_on_a_cut_is_inside(make_sales):
    sales = make_sales([line(1, 80), line(2, 15), line(3, 5)])
    assert classes(a.a01_abc_product_scores(sales, P)) == {1: "A", 2: "B", 3: "C"}
    rows = a.a02_abc_summary(sales, P).collect()
    assert [(r["abc_class"], r["products_count"], r["revenue_share_pct"]) for r in rows] == [
        ("A", 1, 80.0), ("B", 1, 15.0), ("C", 1, 5.0)]


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 7])
def test_equal_revenue_is_ordered_by_product(make_sales, rows_per_slice):
    sales = make_sales([line(product, 10) for product in range(100)])
    p = replace(P, rows_per_slice=rows_per_slice)
    found = classes(a.a01_abc_product_scores(sales, p))
    assert found == {i: "A" if i < 80 else "B" if i < 95 else "C" for i in range(100)}
    assert classes(a.a03_dual_abc_scores(sales, p), "revenue_class") == found


def test_unknown_and_negative_revenue(make_sales):
    sales = make_sales([line(1, 100), line(2, 20), line(3, -30), {**line(4, 1), "total_price": None}])
    found = a.a01_abc_product_scores(sales, P).collect()
    assert [r["product_id"] for r in found] == [4, 1, 2, 3]
    assert [r["cumulative_share_pct"] for r in found][0] is None
    assert classes(a.a03_dual_abc_scores(sales, P), "revenue_class") == {1: "C", 2: "C", 3: "C", 4: "C"}
    assert [r["abc_class"] for r in found] == ["C"] * 4


def test_zero_total_revenue_is_not_an_error(make_sales):
    sales = make_sales([line(1, 0), line(2, 0)])
    assert classes(a.a01_abc_product_scores(sales, P)) == {1: "C", 2: "C"}
    assert classes(a.a03_dual_abc_scores(sales, P), "revenue_class") == {1: "C", 2: "C"}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.integers(1, 12))
def test_classes_agree_with_a_plain_loop(make_sales, values, rows_per_slice):
    revenue = dict(enumerate(values))
    sales = make_sales([line(product, value) for product, value in revenue.items()])
    expected = brute_classes(revenue) if sum(values) else {k: "C" for k in revenue}
    p = replace(P, rows_per_slice=rows_per_slice)
    assert classes(a.a01_abc_product_scores(sales, p)) == expected
    assert classes(a.a03_dual_abc_scores(sales, p), "revenue_class") == expected


@pytest.mark.parametrize("rows_per_slice", [10_000, 40])
def test_running_sum_over_slices(spark, rows_per_slice):
    """A third of the rows share one value, and values are unknown in places."""
    values = [7 if i % 3 == 0 else (i * 37) % 101 for i in range(600)]
    values[5] = values[11] = None
    frame = spark.createDataFrame(list(enumerate(values)), "key int, value int").repartition(8)
    found = running_sum(frame, largest_first("value", "key"), F.col("value"), "upto", 600, rows_per_slice)
    got = {r["key"]: r["upto"] for r in found.collect()}
    total, expected = None, {}
    for key, value in sorted(enumerate(values), key=lambda kv: (kv[1] is not None, -(kv[1] or 0), kv[0])):
        total = total if value is None else (total or 0) + value
        expected[key] = total
    assert got == expected


def test_offsets_over_several_blocks(spark, monkeypatch):
    """Sums before, after and after the next slice, with empty slices and slices without a known value."""
    monkeypatch.setattr(ordered, "SLICES_PER_BLOCK", 4)
    sums = [(k, None if k % 5 == 0 or k == 1 else k * k - 40) for k in range(40) if k % 7 != 3]
    found = {r["_slice"]: r for r in ordered._offsets(spark.createDataFrame(sums, "_slice int, _sum bigint")).collect()}
    plus = lambda a, b: b if a is None else a if b is None else a + b
    before = None
    for at, (k, value) in enumerate(sums):
        after = plus(before, value)
        following = None if at + 1 == len(sums) else plus(after, sums[at + 1][1]) or 0
        assert (found[k]["_before"], found[k]["_after"], found[k]["_next"]) == (before, after, following), k
        before = after


@pytest.mark.parametrize("rows_per_slice", [10_000, 13])
@pytest.mark.parametrize("count", [1, 2, 101, 250])
def test_percentiles_by_histogram(spark, rows_per_slice, count):
    rng = random.Random(count)
    values = [rng.choice([3.0, rng.random() * 100]) for _ in range(count)]
    frame = spark.createDataFrame(list(enumerate(values)), "key int, value double")
    steps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = quantiles(frame, "value", "key", steps, rows_per_slice)
    got = found.values
    built_in = frame.agg(F.percentile("value", F.array(*map(F.lit, steps)))).first()[0]
    assert list(got) == pytest.approx(built_in, abs=1e-9)
    assert (found.n, found.low, found.high) == (count, min(values), max(values))


def plain_classes(rows, cuts):
    """Classes as stretches of the order, up to the last row inside each cut."""
    known = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    total = sum(v for _, v in known)
    classes = {k: "C" for k, _ in rows}
    for label, cut in reversed([*zip("AB", cuts)]):
        running, last = 0, -1
        for place, (_, v) in enumerate(known):
            running += v
            if total and running * 100 * (1 if total > 0 else -1) <= cut * abs(total):
                last = place
        classes |= {k: label for k, _ in known[: last + 1]}
    return classes


@pytest.mark.parametrize("limit", [1, 3, 50, 10_000])
@pytest.mark.parametrize("kind", ["spread", "ties", "one value", "refunds", "losses", "zeros", "few", "heavy"])
def test_pareto_classes_like_a_sorted_list(spark, limit, kind):
    rng = random.Random(kind)
    value = {
        "spread": lambda i: Decimal(rng.randint(1, 10**9)) / 100,
        "ties": lambda i: Decimal(rng.choice([5, 5, 5, 700, 2])),
        "one value": lambda i: Decimal("3.25"),
        "refunds": lambda i: Decimal(rng.randint(-40_000, 90_000)) / 100,
        "losses": lambda i: Decimal(rng.randint(-90_000, 5_000)) / 100,
        "zeros": lambda i: Decimal(0),
        "few": lambda i: Decimal(i + 1),
        "heavy": lambda i: Decimal(10 ** rng.randint(0, 12)),
    }[kind]
    rows = [(i * 7 - 300, value(i)) for i in range(3 if kind == "few" else 240)]
    rows += [(10_000, None)]
    frame = spark.createDataFrame(rows, "key bigint, value decimal(28,2)")
    found, size = pareto_classes(frame, ["value"], "key", (80, 95), limit)
    got = {r["key"]: r["c"] for r in frame.select("key", found["value"].alias("c")).collect()}
    assert got == plain_classes(rows, (80, 95))
    assert size.rows == len(rows) and size.totals["value"] == sum(v for _, v in rows if v is not None)


def spread_sales(make_sales, seed=5, products=30):
    rng = random.Random(seed)
    rows = []
    for product in range(products):
        for _ in range(rng.randint(1, 40)):
            month, price = rng.randint(1, 12), rng.randint(1, 90)
            discount, quantity = rng.randint(0, price), rng.randint(1, 9)
            rows.append(line(product, (price - discount) * quantity, quantity, f"2023-{month:02d}-11", price, discount))
    return rows, make_sales(rows)


def test_variability_without_the_dense_calendar(make_sales):
    rows, sales = spread_sales(make_sales)
    monthly = defaultdict(lambda: [0] * 12)
    for row in rows:
        monthly[row["product_id"]][int(row["purchase_date"][5:7]) - 1] += row["quantity"]
    got = {r["product_id"]: r for r in product_profile(sales, P).collect()}
    for product, units in monthly.items():
        assert got[product]["avg_monthly_sales"] == pytest.approx(mean(units))
        assert got[product]["stddev_monthly_sales"] == pytest.approx(pstdev(units))
        assert got[product]["variation_coef_pct"] == pytest.approx(100 * pstdev(units) / mean(units))
        assert got[product]["active_months"] == sum(u > 0 for u in units)
    dense = defaultdict(dict)
    for r in dense_monthly_units(sales, P).collect():
        dense[r["product_id"]][r["month"]] = r["units_sold"]
    assert {k: [v[date(2023, i, 1)] for i in range(1, 13)] for k, v in dense.items()} == dict(monthly)


def test_one_month_is_volatile_and_level_sales_are_steady(make_sales):
    level = [line(2, 10, 4, f"2023-{month:02d}-01") for month in range(1, 13)]
    rows = a.a06_xyz_product_scores(make_sales([line(1, 10, 5), *level]), P).collect()
    assert [tuple(r) for r in rows] == [
        (2, 4.0, 0.0, 0.0, "X"),
        (1, 0.42, 1.38, round(math.sqrt(11) * 100, 2), "Z")]


def test_variability_exactly_on_a_cut_is_inside(make_sales):
    """Six months of 3 and six of 1: mean 2, deviation 1, exactly 50 percent."""
    rows = [line(1, 10, 3 if month <= 6 else 1, f"2023-{month:02d}-01") for month in range(1, 13)]
    sales = make_sales(rows)
    for cuts, letter in (((50, 75), "X"), ((49.99, 50), "Y"), ((10, 49.99), "Z")):
        assert a.a06_xyz_product_scores(sales, replace(P, xyz_cuts=cuts)).first()["xyz_class"] == letter


def test_segment_reports_hang_together(make_sales):
    rows, sales = spread_sales(make_sales)
    products = len({r["product_id"] for r in rows})
    segments = a.a10_abc_xyz_segments(sales, P).collect()
    assert sum(r["products_count"] for r in segments) == products
    assert sum(r["products_share_pct"] for r in segments) == pytest.approx(100, abs=0.1)
    assert sum(r["revenue"] for r in segments) == sum(r["total_price"] for r in rows)
    assert sum(r["units_sold"] for r in segments) == sum(r["quantity"] for r in rows)
    discounts = {r["segment"]: r for r in a.a11_segment_discounts(sales, P).collect()}
    assert discounts.keys() == {r["segment"] for r in segments}
    review = a.a14_ccz_review(sales, P).collect()
    ccz = [r for r in segments if r["segment"] == "CCZ"]
    assert len(review) == sum(r["products_count"] for r in ccz)
    assert [r["revenue"] for r in review] == sorted(r["revenue"] for r in review)


def test_review_bounds_are_inclusive_and_unrounded(make_sales):
    big = [line(99, 100000, 500, f"2023-{month:02d}-01") for month in range(1, 13)]
    small = [line(1, "10.40", 3), line(2, "10.41", 3), line(3, "9.00", 4)]
    sales = make_sales(big + small)
    p = replace(P, review_max_revenue=10.40, review_max_units=3, review_min_cv=331.66)
    assert [r["product_id"] for r in a.a14_ccz_review(sales, p).collect()] == [3, 1, 2]
    assert [r["product_id"] for r in a.a15_ccz_priority_candidates(sales, p).collect()] == [1]
    over = replace(p, review_min_cv=331.67)
    assert a.a15_ccz_priority_candidates(sales, over).count() == 0


def test_discount_bands(make_sales):
    sales = make_sales([
        line(1, 95, price=100, discount=5), line(2, 96, price=100, discount=4),
        line(3, 90, price=100, discount=10, quantity=3), line(4, 0, price=0, discount=0),
        line(5, 100, price=100, discount=0)])
    assert [tuple(r) for r in a.a12_discount_bands(sales, P).collect()] == [
        ("0–5%", 2, 1.0), ("5–10%", 1, 1.0), ("10–15%", 1, 3.0), ("–%", 1, 1.0)]


def test_correlation_is_unknown_without_variation(make_sales):
    one = make_sales([line(1, 90, price=100, discount=10)])
    assert a.a13_discount_correlation(one, P).first()["discount_sales_correlation"] is None
    level = make_sales([line(i, 90 * i, quantity=i, price=100, discount=10) for i in range(1, 6)])
    assert {r["discount_sales_correlation"] for r in a.a13_discount_correlation(level, P).collect()} == {None}
    assert m.m3_discount_units_correlation(level, P).first()["discount_sales_correlation"] is None
    falling = make_sales([line(i, 10, quantity=i, price=100, discount=50 - i) for i in range(1, 6)])
    assert m.m3_discount_units_correlation(falling, P).first()["discount_sales_correlation"] == -1.0


def test_candidate_months_by_list_and_by_table(spark, make_sales):
    sales = make_sales([line(1, 10, 2), line(1, 5, 1, "2023-03-20"), line(1, 7, 1, "2023-08-01"), line(2, 9)])
    by_list = a.a16_candidate_monthly_sales(sales, replace(P, candidate_ids=(1, 55))).collect()
    assert [tuple(r) for r in by_list] == [(1, date(2023, 3, 1), 3, 15.0), (1, date(2023, 8, 1), 1, 7.0)]
    table = spark.createDataFrame([(1,), (55,)], "product_id bigint")
    assert a.a16_candidate_monthly_sales(sales, P, table).collect() == by_list


def test_empty_input(make_sales):
    empty = make_sales([])
    for name, report in vars(a).items():
        if name.startswith("a") and name[1:3].isdigit() and name != "a08_cv_distribution":
            assert report(empty, P).count() == 0, name
    assert set(a.a08_cv_distribution(empty, P).first()) == {None}


def test_amount_check(make_sales):
    sales = make_sales([line(1, 90, price=100, discount=10), line(2, "91.50", price=100, discount=10),
                        line(3, 170, 2, price=100, discount=10), {**line(4, 5), "total_price": None}])
    row = m.m1_amount_check(sales, P).first()
    assert (row["rows_count"], row["broken_rows"], row["total_gap"], row["largest_gap"]) == (4, 3, 11.5, 10.0)
    assert sorted(r["product_id"] for r in m.m1_broken_rows(sales, P).collect()) == [2, 3, 4]


def test_large_money_stays_exact(make_sales):
    huge = Decimal("9999999999999.99")
    sales = make_sales([line(1, huge), line(1, huge), line(2, "0.01")])
    summary = a.a02_abc_summary(sales, replace(P, abc_cuts=(100, 100))).collect()
    assert [(r["abc_class"], r["products_count"]) for r in summary] == [("A", 2)]
    edge = a.a01_abc_product_scores(sales, replace(P, abc_cuts=(99, 100))).collect()
    assert [r["abc_class"] for r in edge] == ["B", "B"]
