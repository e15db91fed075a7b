"""Customer reports on hand-made rows whose results can be checked by hand."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest

from cartlens import Params
from cartlens.operators.cohorts import activity_cells, revenue_cells
from cartlens.plans import customers as c

P = Params()


def column(frame, name):
    return [row[name] for row in frame.collect()]


def test_cohort_grid_keeps_observed_zeros_and_leaves_out_the_future(retention):
    rows = c.c07_cohort_retention(retention, P).collect()
    per_cohort = {}
    for row in rows:
        per_cohort.setdefault(row["cohort_month"].month, []).append(row)
    assert {month: len(found) for month, found in per_cohort.items()} == {1: 12, 2: 11, 6: 7, 7: 6, 12: 1}
    january = per_cohort[1]
    assert [r["month_number"] for r in january] == list(range(12))
    assert [(r["active_clients"], r["retention_pct"]) for r in january[:3]] == [(2, 100.0), (0, 0.0), (1, 50.0)]
    assert per_cohort[12][0]["month_number"] == 0


def test_curve_keeps_inactive_cohorts_in_the_denominator(retention):
    rows = {r["month_number"]: r for r in c.c08_retention_curve(retention, P).collect()}
    assert len(rows) == 12
    seen = {k: (r["active_clients"], r["customers_at_start"], r["retention_pct"]) for k, r in rows.items()}
    assert seen[0] == (6, 6, 100.0)
    assert seen[1] == (1, 5, 20.0)
    assert seen[6] == (1, 4, 25.0)
    assert seen[11] == (0, 2, 0.0)


def test_fixed_cohorts(retention):
    frame = c.c11_retention_revenue(retention, P).cache()
    assert column(frame, "month_number") == list(range(7))
    assert column(frame, "cohort_size") == [4] * 7
    assert column(frame, "active_clients") == [4, 1, 1, 0, 0, 0, 1]
    assert column(frame, "retention_pct") == [100, 25, 25, 0, 0, 0, 25]
    assert column(frame, "revenue_per_original_customer") == [135, 8, 15, 0, 0, 0, 10]
    assert column(frame, "revenue_per_active_customer") == [135, 30, 60, None, None, None, 40]


def test_ltv_shares_the_client_base_of_the_fixed_cohorts(retention):
    frame = c.c10_ltv_fixed_cohorts(retention, P).cache()
    assert column(frame, "customers_count") == [4] * 7
    assert column(frame, "cumulative_revenue_per_customer") == [135, 143, 158, 158, 158, 158, 168]
    assert column(frame, "growth_vs_m0_pct") == [0.0, 5.56, 16.67, 16.67, 16.67, 16.67, 24.07]


def test_late_cohorts_and_empty_input_make_no_rows(retention, make_sales):
    late = retention.where("purchase_date >= '2023-07-01'")
    assert c.c11_retention_revenue(late, P).count() == 0
    empty = make_sales([])
    for report in (c.c07_cohort_retention, c.c08_retention_curve, c.c09_ltv_exploration, c.c10_ltv_fixed_cohorts,
                   c.c11_retention_revenue, c.c13_repeat_rate, c.c01_customer_metrics, c.c04_frequency_distribution,
                   c.c05_rfm_scores, c.c06_rfm_segments):
        assert report(empty, P).count() == 0
    assert c.c02_customer_summary(empty, P).collect()[0].asDict() == {
        "customers_count": 0, "avg_active_days": None, "median_active_days": None,
        "avg_revenue": None, "median_revenue": None}
    assert set(c.c03_rfm_percentiles(empty, P).first().asDict().values()) == {None}
    assert c.c14_time_to_second_day(empty, P).first()["repeat_customers"] == 0


def test_client_table(retention):
    rows = c.c01_customer_metrics(retention, P).collect()
    assert [(r["client_id"], r["revenue"], r["active_days"], r["units_bought"]) for r in rows] == [
        (401, 900, 1, 1), (501, 500, 1, 1), (101, 240, 3, 4), (102, 200, 1, 1), (301, 150, 2, 2), (201, 80, 1, 1)]
    assert rows[2]["first_purchase_date"] == date(2023, 1, 10)
    assert rows[2]["last_purchase_date"] == date(2023, 7, 10)


def test_gender_is_the_largest_letter(make_sales):
    rows = [{"client_id": i, "purchase_date": "2023-02-01", "quantity": 1, "total_price": 1, "gender": g}
            for i, g in [(1, "F"), (1, "M"), (1, None), (2, None), (3, "Ж"), (3, "M"), (4, "")]]
    found = {r["client_id"]: r["gender"] for r in c.c01_customer_metrics(make_sales(rows), P).collect()}
    assert found == {1: "M", 2: None, 3: "Ж", 4: ""}


def test_summary_and_percentiles(retention):
    assert c.c02_customer_summary(retention, P).first().asDict() == {
        "customers_count": 6, "avg_active_days": 1.5, "median_active_days": 1.0,
        "avg_revenue": 345.0, "median_revenue": 220.0}
    row = c.c03_rfm_percentiles(retention, P).first().asDict()
    assert [row[f"r_{x}"] for x in ("min", "p20", "p40", "p60", "p80", "max")] == [27, 170, 175, 184, 330, 346]
    assert [row[f"f_{x}"] for x in ("min", "p20", "p40", "p60", "p80", "max")] == [1, 1, 1, 1, 2, 3]
    assert [row[f"m_{x}"] for x in ("min", "p20", "p40", "p60", "p80", "max")] == [80, 150, 200, 240, 500, 900]
    shares = [(r["frequency"], r["customers_count"], r["customers_share_pct"])
              for r in c.c04_frequency_distribution(retention, P).collect()]
    assert shares == [(1, 4, 66.67), (2, 1, 16.67), (3, 1, 16.67)]


def test_scores_and_segments(retention):
    scores = {r["client_id"]: r["rfm_score"] for r in c.c05_rfm_scores(retention, P).collect()}
    assert scores == {101: "231", 102: "111", 201: "111", 301: "221", 401: "211", 501: "511"}
    english = c.c06_rfm_segments(retention, replace(P, segment_language="en")).collect()
    assert {r["segment"]: r["customers_count"] for r in english} == {"new": 1, "sleeping": 4, "other": 1}
    native = c.c06_rfm_segments(retention, P).collect()
    assert {r["segment"]: r["customers_count"] for r in native} == {"Новые": 1, "Спящие": 4, "Остальные": 1}


def test_open_ltv_leaves_out_months_without_revenue(retention):
    rows = c.c09_ltv_exploration(retention, P).collect()
    assert [(r["month_number"], r["cumulative_revenue"], r["customers_at_start"],
             r["cumulative_revenue_per_customer"]) for r in rows] == [
        (0, 1940, 6, 323), (1, 150, 1, 150), (2, 400, 2, 200), (6, 440, 2, 220)]


def test_scenarios(retention, make_sales):
    frame = c.c12_retention_scenarios(retention, P).cache()
    assert column(frame, "baseline_retention_pct") == [25.0] * 4
    assert column(frame, "scenario_retention_pct") == [25, 26, 28, 30]
    assert column(frame, "extra_active_clients") == [0, 0, 0, 0]
    assert column(frame, "revenue_per_active_customer") == [30] * 4
    assert column(frame, "incremental_revenue") == [0, 1, 4, 6]
    nobody_back = c.c12_retention_scenarios(make_sales([(1, "2023-01-05", 1, 10)]), P).collect()
    assert [(r["baseline_retention_pct"], r["revenue_per_active_customer"], r["incremental_revenue"])
            for r in nobody_back] == [(0.0, None, None)] * 4


def test_next_month_behind_the_period_still_counts_in_scenarios(make_sales):
    short = Params(start=date(2023, 1, 1), end=date(2023, 2, 1))
    rows = [(1, "2023-01-05", 1, 10), (2, "2023-01-06", 1, 10), (1, "2023-02-07", 1, 50), (9, "2023-02-08", 1, 70)]
    first = c.c12_retention_scenarios(make_sales(rows), short).first()
    assert (first["baseline_retention_pct"], first["revenue_per_active_customer"]) == (50.0, 50.0)


def test_repeat_rate(retention):
    rows = c.c13_repeat_rate(retention, P).collect()
    assert [tuple(r) for r in rows] == [(30, 5, 1, 20.0), (60, 5, 2, 40.0), (90, 5, 2, 40.0)]


@pytest.mark.parametrize("first,eligible", [("2023-12-02", 0), ("2023-12-01", 1)])
def test_window_must_end_before_the_period(make_sales, first, eligible):
    one = Params(repeat_windows=(30,))
    found = c.c13_repeat_rate(make_sales([(1, first, 1, 5)]), one).collect()
    assert [r["eligible_customers"] for r in found] == [1] * eligible


def test_day_thirty_counts_and_day_thirty_one_does_not(make_sales):
    rows = [(1, "2023-01-01", 1, 5), (1, "2023-01-31", 1, 5), (2, "2023-01-01", 1, 5), (2, "2023-02-01", 1, 5),
            (3, "2023-01-01", 1, 5), (3, "2023-01-01", 1, 5)]
    found = c.c13_repeat_rate(make_sales(rows), Params(repeat_windows=(30,))).first()
    assert (found["eligible_customers"], found["repeat_customers"]) == (3, 1)


def test_time_to_second_day(retention):
    assert tuple(c.c14_time_to_second_day(retention, P).first()) == (2, 42.0, 36.0, 42.0, 48.0, 51.6)


def test_activity_cells_agree_with_revenue_cells_over_many_months(make_sales):
    """80 months need two words of month bits."""
    long = Params(start=date(2015, 1, 1), end=date(2021, 9, 1))
    rows = []
    for client in range(40):
        for step in range(client % 7 + 1):
            month = (client * 13 + step * 17) % 80
            rows.append((client, f"{2015 + month // 12}-{month % 12 + 1:02d}-03", 1, 10))
    sales = make_sales(rows)
    bits = {tuple(r) for r in activity_cells(sales, long).collect()}
    plain = {tuple(r)[:3] for r in revenue_cells(sales, long).collect()}
    assert bits == plain and len({cohort for cohort, _, _ in bits}) > 10


def test_one_client_with_a_third_of_all_rows(make_sales):
    rows = [(1, f"2023-{i % 12 + 1:02d}-{i % 28 + 1:02d}", 1, 1) for i in range(300)]
    rows += [(client, "2023-05-05", 1, 1) for client in range(2, 602)]
    sales = make_sales(rows)
    top = c.c01_customer_metrics(sales, P).first()
    assert (top["client_id"], top["revenue"], top["units_bought"]) == (1, 300.0, 300)
    assert top["active_days"] == len({row[1] for row in rows if row[0] == 1})
    assert c.c07_cohort_retention(sales, P).agg({"active_clients": "sum"}).first()[0] == 12 + 600


def test_a_gender_of_two_letters_is_an_error(make_sales):
    sales = make_sales([{"client_id": 1, "gender": "mx", "purchase_date": "2023-01-01", "quantity": 1}])
    with pytest.raises(Exception, match="more than one letter: mx"):
        c.c01_customer_metrics(sales, P).collect()
