"""DuckDB SQL that computes each registered query in its plain form.

The texts use dense calendars, global windows, self joins and built-in
aggregates on purpose: the Spark side gets the same results in other ways.
"""

from __future__ import annotations

from datetime import date

from cartlens import Params


def later(day: date, months: int) -> str:
    """SQL for the first day of the month `months` after that of `day`."""
    return f"CAST(DATE '{day:%Y-%m}-01' + INTERVAL {months} MONTH AS DATE)"


def months_between(start: date, end: date) -> int:
    """Months touched by the days from `start` up to, not including, `end`."""
    whole = (end.year - start.year) * 12 + end.month - start.month
    return whole + (end.day > 1)


def hu(expression: str, digits: int) -> str:
    """Round half away from zero, as a double."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str) -> str:
    return f"(100.0::DOUBLE * CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def cuts(value: str, bounds, labels) -> str:
    arms = " ".join(f"WHEN {value} <= {b} THEN {l!r}" for b, l in zip(bounds, labels))
    return f"CASE {arms} ELSE {labels[-1]!r} END"


class Oracle:
    def __init__(self, p: Params, billed: bool = False):
        self.p = p
        n_months = months_between(p.start, p.end)
        total = (
            "CAST(ROUND(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,8)), 2) AS DECIMAL(18,2))"
            if billed
            else "CAST((price_per_item - discount_per_item) * quantity AS DECIMAL(18,2))"
        )
        self.parts = {
            "priced": """
                SELECT o_custkey AS client_id, o_orderstatus AS gender,
                       CAST(o_orderdate AS DATE) AS purchase_date, l_partkey AS product_id,
                       CAST(l_quantity AS INTEGER) AS quantity,
                       CAST(ROUND(l_extendedprice / l_quantity) AS BIGINT) AS price_per_item,
                       CAST(ROUND(l_discount * 100) AS BIGINT) AS off, l_extendedprice, l_discount
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
            "discounted": "SELECT *, (price_per_item * off + 50) // 100 AS discount_per_item FROM priced",
            "sales": f"SELECT *, {total} AS total_price FROM discounted",
            "rowset": f"""
                SELECT *, CAST(date_trunc('month', purchase_date) AS DATE) AS mon FROM sales
                WHERE quantity > 0 AND purchase_date >= DATE '{p.start}' AND purchase_date < DATE '{p.end}'""",
            # products
            "item": """
                SELECT product_id, SUM(total_price) AS rev, SUM(quantity) AS qty,
                       SUM(price_per_item * quantity) AS gross, SUM(discount_per_item * quantity) AS disc
                FROM rowset GROUP BY product_id""",
            "ranked": """
                SELECT *, SUM(rev) OVER () AS rev_all, SUM(qty) OVER () AS qty_all,
                       SUM(rev) OVER (ORDER BY rev DESC, product_id ROWS UNBOUNDED PRECEDING) AS rev_run,
                       SUM(qty) OVER (ORDER BY qty DESC, product_id ROWS UNBOUNDED PRECEDING) AS qty_run
                FROM item""",
            "classed": f"""
                SELECT *, {self.abc('rev')} AS rc, {self.abc('qty')} AS qc FROM ranked""",
            "cal": f"""
                SELECT CAST(range AS DATE) AS mon
                FROM range({later(p.start, 0)}, {later(p.start, n_months)}, INTERVAL 1 MONTH)""",
            "grid": """
                SELECT g.product_id, g.mon, COALESCE(SUM(r.quantity), 0) AS u
                FROM (SELECT product_id, cal.mon FROM item, cal) g
                LEFT JOIN rowset r ON r.product_id = g.product_id AND r.mon = g.mon
                GROUP BY ALL""",
            "wave": """
                SELECT product_id, AVG(u) AS mean_u, STDDEV_POP(u) AS dev_u, CAST(COUNT_IF(u > 0) AS BIGINT) AS live,
                       STDDEV_POP(u) / AVG(u) * 100 AS cv
                FROM grid GROUP BY product_id""",
            "lettered": f"SELECT *, {cuts('cv', p.xyz_cuts, 'XYZ')} AS xc FROM wave",
            "segmented": """
                SELECT *, rc || qc || xc AS seg FROM classed JOIN lettered USING (product_id)""",
            # clients
            "person": f"""
                SELECT client_id, MAX(gender) AS gender, MIN(purchase_date) AS d1, MAX(purchase_date) AS d9,
                       COUNT(DISTINCT purchase_date) AS freq, SUM(quantity) AS qty, SUM(total_price) AS rev,
                       CAST(DATE '{p.end}' - MAX(purchase_date) AS INTEGER) AS rec
                FROM rowset GROUP BY client_id""",
            "scored": f"""
                SELECT *, {cuts('rec', p.recency_cuts, (5, 4, 3, 2, 1))} AS r,
                       {cuts('freq', p.frequency_cuts, (1, 2, 3, 4, 5))} AS f,
                       {cuts('rev', p.monetary_cuts, (1, 2, 3, 4, 5))} AS m
                FROM person""",
            "named": f"SELECT *, {self.segment()} AS seg FROM scored",
            # cohorts
            "born": """
                SELECT client_id, CAST(date_trunc('month', d1) AS DATE) AS coh FROM person""",
            "sized": "SELECT coh, COUNT(*) AS n FROM born GROUP BY coh",
            "cell": """
                SELECT coh, date_diff('month', coh, mon) AS k, COUNT(DISTINCT r.client_id) AS act,
                       SUM(total_price) AS rev
                FROM rowset r JOIN born USING (client_id) GROUP BY ALL""",
            "seen": f"""
                SELECT s.coh, t.k, s.n, COALESCE(c.act, 0) AS act
                FROM sized s, (SELECT unnest(range({n_months})) AS k) t
                LEFT JOIN cell c ON c.coh = s.coh AND c.k = t.k
                WHERE s.coh + to_months(CAST(t.k AS INTEGER)) < {later(p.start, n_months)}""",
            "fixed": f"""
                SELECT s.coh, t.k, s.n, COALESCE(c.act, 0) AS act, COALESCE(c.rev, 0) AS rev
                FROM sized s, (SELECT unnest(range({p.fixed_horizon + 1})) AS k) t
                LEFT JOIN cell c ON c.coh = s.coh AND c.k = t.k
                WHERE s.coh < {later(p.start, p.fixed_cohorts)}""",
            "days": "SELECT DISTINCT client_id, purchase_date AS d FROM rowset",
        }

    def abc(self, metric: str) -> str:
        a, b = self.p.abc_cuts
        run, whole = f"{metric}_run * 100", f"{metric}_all"
        return f"CASE WHEN {run} <= {a} * {whole} THEN 'A' WHEN {run} <= {b} * {whole} THEN 'B' ELSE 'C' END"

    def segment(self) -> str:
        """The rules as the study words them; the first that holds names the segment."""
        english, russian = (
            """CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'best'
                    WHEN r >= 3 AND f >= 4 AND m >= 3 THEN 'loyal'
                    WHEN r >= 4 AND f BETWEEN 2 AND 3 AND m >= 2 THEN 'promising'
                    WHEN r = 5 AND f = 1 THEN 'new'
                    WHEN r >= 4 AND f <= 2 THEN 'active_low_frequency'
                    WHEN r = 3 THEN 'needs_attention'
                    WHEN r <= 2 AND f >= 4 AND m >= 3 THEN 'at_risk'
                    WHEN r <= 2 AND m >= 4 THEN 'valuable_reactivate'
                    WHEN r <= 2 AND m = 3 THEN 'leaving'
                    WHEN r <= 2 AND f <= 2 AND m <= 2 THEN 'sleeping'
                    ELSE 'other' END""",
            """CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Лучшие клиенты'
                    WHEN r >= 3 AND f >= 4 AND m >= 3 THEN 'Лояльные'
                    WHEN r >= 4 AND f BETWEEN 2 AND 3 AND m >= 2 THEN 'Перспективные'
                    WHEN r = 5 AND f = 1 THEN 'Новые'
                    WHEN r >= 4 AND f <= 2 THEN 'Активные низкой частоты'
                    WHEN r = 3 THEN 'Требуют внимания'
                    WHEN r <= 2 AND f >= 4 AND m >= 3 THEN 'Под риском'
                    WHEN r <= 2 AND m >= 4 THEN 'Ценные, требуют реактивации'
                    WHEN r <= 2 AND m = 3 THEN 'Уходящие'
                    WHEN r <= 2 AND f <= 2 AND m <= 2 THEN 'Спящие'
                    ELSE 'Остальные' END""",
        )
        return english if self.p.segment_language == "en" else russian

    def __call__(self, last: str, body: str) -> str:
        """`body` behind all named parts up to `last`."""
        names = list(self.parts)
        used = names[: names.index(last) + 1]
        return "WITH " + ",\n".join(f"{n} AS ({self.parts[n]})" for n in used) + "\n" + body

    # ---- assortment ----
    def reports(self) -> dict[str, str]:
        p = self.p
        share = "100.0 * COUNT(*) / SUM(COUNT(*)) OVER ()"
        price = hu(div("SUM(rev)", "SUM(qty)"), 2)
        shelf = f"""
            SELECT product_id, {hu('rev', 0)} AS revenue, {big('qty')} AS units_sold, live AS active_months,
                   {hu('mean_u', 1)} AS avg_monthly_sales, {hu('cv', 2)} AS cv_pct,
                   {hu(div('rev', 'qty'), 2)} AS avg_price_per_unit,
                   {hu(pct('disc', 'gross'), 2)} AS discount_rate_pct
            FROM segmented WHERE seg = '{p.review_segment}'"""
        picked = (
            f" AND rev <= {p.review_max_revenue} AND qty <= {p.review_max_units} AND cv >= {p.review_min_cv}"
        )
        letters = lambda bounds: f"""
            SELECT {cuts('cv', bounds, 'XYZ')} AS xyz_class, COUNT(*) AS products_count,
                   {hu(share, 2)} AS products_share_pct, {hu('AVG(cv)', 2)} AS avg_variation_coef_pct
            FROM wave GROUP BY 1"""
        joint = f"rc || qc AS abc_class, COUNT(*) AS products_count"
        q = lambda column, x: f"quantile_cont(CAST({column} AS DOUBLE), {x})"
        corr = lambda x, y: (
            f"covar_pop({x}, CAST({y} AS DOUBLE)) / NULLIF(stddev_pop({x}) * stddev_pop(CAST({y} AS DOUBLE)), 0)"
        )
        rate = f"{pct('disc', 'gross')}"
        kept = lambda column: hu(f"{column}", 0)
        out = {
            "a01_abc_product_scores": self("classed", """
                SELECT product_id, CAST(rev AS DOUBLE) AS revenue, CAST(qty AS BIGINT) AS units_sold,
                       CAST(rev AS DOUBLE) / CAST(rev_all AS DOUBLE) * 100 AS revenue_share_pct,
                       CAST(rev_run AS DOUBLE) / CAST(rev_all AS DOUBLE) * 100 AS cumulative_share_pct,
                       rc AS abc_class
                FROM classed ORDER BY rev DESC, product_id"""),
            "a02_abc_summary": self("classed", f"""
                SELECT rc AS abc_class, COUNT(*) AS products_count, {hu(share, 2)} AS products_share_pct,
                       {hu('SUM(rev)', 0)} AS revenue,
                       {hu(pct('SUM(rev)', 'SUM(SUM(rev)) OVER ()'), 2)} AS revenue_share_pct
                FROM classed GROUP BY rc ORDER BY rc"""),
            "a03_dual_abc_scores": self("classed", """
                SELECT product_id, CAST(rev AS DOUBLE) AS revenue, CAST(qty AS BIGINT) AS units_sold,
                       rc AS revenue_class, qc AS units_class, rc || qc AS abc_class
                FROM classed ORDER BY rev DESC, product_id"""),
            "a04_dual_abc_summary": self("classed", f"""
                SELECT {joint}, {hu(share, 2)} AS products_share_pct, {hu('SUM(rev)', 0)} AS revenue,
                       {big('SUM(qty)')} AS units_sold
                FROM classed GROUP BY 1 ORDER BY 1"""),
            "a05_abc_price_comparison": self("classed", f"""
                SELECT {joint}, {hu(div('SUM(rev)', 'COUNT(*)'), 0)} AS avg_revenue_per_product,
                       {hu(div('SUM(qty)', 'COUNT(*)'), 1)} AS avg_units_per_product,
                       {price} AS avg_price_per_unit
                FROM classed GROUP BY 1 ORDER BY 1"""),
            "a06_xyz_product_scores": self("lettered", f"""
                SELECT product_id, {hu('mean_u', 2)} AS avg_monthly_sales, {hu('dev_u', 2)} AS stddev_monthly_sales,
                       {hu('cv', 2)} AS variation_coef_pct, xc AS xyz_class
                FROM lettered ORDER BY 4, 1"""),
            "a07_xyz_classic_summary": self("wave", letters(p.xyz_classic_cuts) + " ORDER BY 1"),
            "a08_cv_distribution": self("wave", "SELECT " + ", ".join(
                [f"{hu('MIN(cv)', 2)} AS min_cv"]
                + [f"{hu(q('cv', x), 2)} AS {n}" for n, x in
                   (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))]
                + [f"{hu('MAX(cv)', 2)} AS max_cv"]) + " FROM wave"),
            "a09_xyz_adapted_summary": self("wave", letters(p.xyz_cuts) + " ORDER BY 1"),
            "a10_abc_xyz_segments": self("segmented", f"""
                SELECT seg AS segment, COUNT(*) AS products_count, {hu(share, 2)} AS products_share_pct,
                       {hu('SUM(rev)', 0)} AS revenue, {big('SUM(qty)')} AS units_sold,
                       {price} AS avg_price_per_unit, {hu('AVG(cv)', 2)} AS avg_cv_pct
                FROM segmented GROUP BY seg ORDER BY seg"""),
            "a11_segment_discounts": self("segmented", f"""
                SELECT seg AS segment, COUNT(*) AS products_count,
                       {hu(pct('SUM(disc)', 'SUM(gross)'), 2)} AS discount_rate_pct, {price} AS avg_price_per_unit,
                       {hu('SUM(rev)', 0)} AS revenue, {big('SUM(qty)')} AS units_sold
                FROM segmented GROUP BY seg ORDER BY seg"""),
            "a12_discount_bands": self("item", f"""
                SELECT concat(CAST(low AS INTEGER), '–', CAST(low + {p.discount_band} AS INTEGER), '%') AS discount_group,
                       COUNT(*) AS products_count, {hu('AVG(qty)', 1)} AS avg_units_sold
                FROM (SELECT qty, FLOOR({rate} / {p.discount_band}) * {p.discount_band} AS low FROM item)
                GROUP BY low ORDER BY low"""),
            "a13_discount_correlation": self("segmented", f"""
                SELECT seg AS segment, COUNT(*) AS products_count, {hu('AVG(rate)', 2)} AS avg_discount_pct,
                       {hu(corr('rate', 'qty'), 4)} AS discount_sales_correlation
                FROM (SELECT seg, qty, {rate} AS rate FROM segmented) GROUP BY seg ORDER BY seg"""),
            "a14_ccz_review": self("segmented", shelf + " ORDER BY 2, 3, 4, 1"),
            "a15_ccz_priority_candidates": self("segmented", shelf + picked + " ORDER BY 2, 1"),
            "a16_candidate_monthly_sales": self("segmented", f"""
                SELECT product_id, mon AS month, {big('SUM(quantity)')} AS units_sold,
                       {hu('SUM(total_price)', 0)} AS revenue
                FROM rowset WHERE product_id IN (
                    SELECT product_id FROM segmented WHERE seg = '{p.review_segment}'{picked})
                GROUP BY ALL ORDER BY 1, 2"""),
            # ---- customers ----
            "c01_customer_metrics": self("person", f"""
                SELECT client_id, gender, d1 AS first_purchase_date, d9 AS last_purchase_date, freq AS active_days,
                       {big('qty')} AS units_bought, CAST(rev AS DOUBLE) AS revenue
                FROM person ORDER BY rev DESC, client_id"""),
            "c02_customer_summary": self("person", f"""
                SELECT COUNT(*) AS customers_count, {hu('AVG(freq)', 2)} AS avg_active_days,
                       {hu(q('freq', 0.5), 2)} AS median_active_days, {hu('AVG(CAST(rev AS DOUBLE))', 0)} AS avg_revenue,
                       {hu(q('rev', 0.5), 0)} AS median_revenue
                FROM person"""),
            "c03_rfm_percentiles": self("person", "SELECT " + ", ".join(
                piece
                for letter, column, digits in (("r", "rec", 6), ("f", "freq", 6), ("m", "rev", 0))
                for piece in (
                    [(f"MIN({column})" if digits else hu(f"MIN({column})", 0)) + f" AS {letter}_min"]
                    + [f"{hu(q(column, x / 100), digits)} AS {letter}_p{x}" for x in (20, 40, 60, 80)]
                    + [(f"MAX({column})" if digits else hu(f"MAX({column})", 0)) + f" AS {letter}_max"]
                )) + " FROM person"),
            "c04_frequency_distribution": self("person", f"""
                SELECT freq AS frequency, COUNT(*) AS customers_count, {hu(share, 2)} AS customers_share_pct
                FROM person GROUP BY freq ORDER BY freq"""),
            "c05_rfm_scores": self("scored", f"""
                SELECT client_id, gender, d1 AS first_purchase_date, d9 AS last_purchase_date,
                       rec AS recency_days, freq AS frequency, {hu('rev', 0)} AS monetary,
                       r AS r_score, f AS f_score, m AS m_score, concat(r, f, m) AS rfm_score
                FROM scored ORDER BY r DESC, f DESC, m DESC, client_id"""),
            "c06_rfm_segments": self("named", f"""
                SELECT seg AS segment, COUNT(*) AS customers_count, {hu(share, 2)} AS customers_share_pct,
                       {hu('SUM(rev)', 0)} AS revenue,
                       {hu(pct('SUM(rev)', 'SUM(SUM(rev)) OVER ()'), 2)} AS revenue_share_pct,
                       {hu('AVG(rec)', 1)} AS avg_recency_days, {hu('AVG(freq)', 2)} AS avg_frequency,
                       {hu(div('SUM(rev)', 'COUNT(*)'), 0)} AS avg_monetary
                FROM named GROUP BY seg ORDER BY SUM(rev) DESC, seg"""),
            "c07_cohort_retention": self("seen", f"""
                SELECT coh AS cohort_month, CAST(k AS INTEGER) AS month_number, act AS active_clients,
                       n AS cohort_size, {hu(pct('act', 'n'), 2)} AS retention_pct
                FROM seen ORDER BY 1, 2"""),
            "c08_retention_curve": self("seen", f"""
                SELECT CAST(k AS INTEGER) AS month_number, {big('SUM(act)')} AS active_clients,
                       {big('SUM(n)')} AS customers_at_start, {hu(pct('SUM(act)', 'SUM(n)'), 2)} AS retention_pct
                FROM seen GROUP BY k ORDER BY 1"""),
            "c09_ltv_exploration": self("cell", f"""
                SELECT CAST(k AS INTEGER) AS month_number, CAST(SUM(cum) AS DOUBLE) AS cumulative_revenue,
                       {big('SUM(n)')} AS customers_at_start,
                       {hu(div('SUM(cum)', 'SUM(n)'), 0)} AS cumulative_revenue_per_customer
                FROM (SELECT k, n, SUM(rev) OVER (PARTITION BY coh ORDER BY k) AS cum
                      FROM cell JOIN sized USING (coh))
                GROUP BY k ORDER BY 1"""),
            "c10_ltv_fixed_cohorts": self("fixed", f"""
                , curve AS (
                    SELECT k, SUM(n) AS n, SUM(cum) AS cum, {div('SUM(cum)', 'SUM(n)')} AS each
                    FROM (SELECT k, n, SUM(rev) OVER (PARTITION BY coh ORDER BY k) AS cum FROM fixed) GROUP BY k)
                SELECT CAST(k AS INTEGER) AS month_number, {hu('cum', 0)} AS cumulative_revenue,
                       {big('n')} AS customers_count, {hu('each', 0)} AS cumulative_revenue_per_customer,
                       {hu('100.0::DOUBLE * each / (SELECT each FROM curve WHERE k = 0) - 100', 2)} AS growth_vs_m0_pct
                FROM curve ORDER BY 1"""),
            "c11_retention_revenue": self("fixed", f"""
                SELECT CAST(k AS INTEGER) AS month_number, {big('SUM(act)')} AS active_clients,
                       {big('SUM(n)')} AS cohort_size, {hu(pct('SUM(act)', 'SUM(n)'), 2)} AS retention_pct,
                       {hu(div('SUM(rev)', 'SUM(n)'), 0)} AS revenue_per_original_customer,
                       {hu(div('SUM(rev)', 'SUM(act)'), 0)} AS revenue_per_active_customer
                FROM fixed GROUP BY k ORDER BY 1"""),
            # One row per client of the first cohorts with what it paid in the month after its first:
            # nothing at all (NULL) means it did not come back.
            "c12_retention_scenarios": self("born", f"""
                , back AS (
                    SELECT b.client_id, COUNT(s.client_id) > 0 AS returned, SUM(s.total_price) AS paid
                    FROM born b
                    LEFT JOIN sales s ON s.client_id = b.client_id AND s.quantity > 0
                        AND s.purchase_date >= b.coh + INTERVAL 1 MONTH AND s.purchase_date < b.coh + INTERVAL 2 MONTH
                    WHERE b.coh < {later(p.start, p.fixed_cohorts)}
                    GROUP BY b.client_id),
                rates AS (
                    SELECT COUNT(*) AS n, {pct('COUNT_IF(returned)', 'COUNT(*)')} AS share,
                           {div('SUM(paid)', 'COUNT_IF(returned)')} AS each FROM back)
                SELECT unnest({list(p.uplifts_pp)}) AS retention_uplift_pp, {hu('share', 2)} AS baseline_retention_pct,
                       {hu(f'share + unnest({list(p.uplifts_pp)})', 2)} AS scenario_retention_pct,
                       {hu(f'n * unnest({list(p.uplifts_pp)}) / 100.0::DOUBLE', 0)} AS extra_active_clients,
                       {hu('each', 0)} AS revenue_per_active_customer,
                       {hu(f'n * unnest({list(p.uplifts_pp)}) / 100.0::DOUBLE * each', 0)} AS incremental_revenue
                FROM rates ORDER BY 1"""),
            "c13_repeat_rate": self("days", f"""
                , win AS (SELECT unnest({list(p.repeat_windows)}) AS w),
                flag AS (
                    SELECT w, person.client_id,
                           MAX(CASE WHEN d > d1 AND d <= d1 + CAST(w AS INTEGER) THEN 1 ELSE 0 END) AS back
                    FROM person, win JOIN days ON days.client_id = person.client_id
                    WHERE d1 + CAST(w AS INTEGER) < DATE '{p.end}' GROUP BY ALL)
                SELECT w AS window_days, COUNT(*) AS eligible_customers, {big('SUM(back)')} AS repeat_customers,
                       {hu('100.0 * SUM(back) / COUNT(*)', 2)} AS repeat_rate_pct
                FROM flag GROUP BY w ORDER BY w"""),
            "c14_time_to_second_day": self("days", f"""
                , gap AS (
                    SELECT MIN(d) - d1 AS g FROM days JOIN person USING (client_id) WHERE d > d1
                    GROUP BY client_id, d1)
                SELECT COUNT(*) AS repeat_customers, {hu('AVG(g)', 1)} AS avg_days,
                       {hu(q('g', 0.25), 6)} AS p25_days, {hu(q('g', 0.5), 6)} AS median_days,
                       {hu(q('g', 0.75), 6)} AS p75_days, {hu(q('g', 0.9), 6)} AS p90_days
                FROM gap"""),
            # ---- figures from the text ----
            "m1_amount_check": self("rowset", f"""
                SELECT COUNT(*) AS rows_count, CAST(COUNT_IF(gap <> 0) AS BIGINT) AS broken_rows,
                       {hu('SUM(ABS(gap))', 2)} AS total_gap, CAST(MAX(ABS(gap)) AS DOUBLE) AS largest_gap
                FROM (SELECT total_price - CAST((price_per_item - discount_per_item) * quantity AS DECIMAL(18,2)) AS gap
                      FROM rowset)"""),
            "m1_broken_rows": self("rowset", """
                SELECT client_id, gender, purchase_date, 0 AS purchase_time_as_seconds_from_midnight, product_id,
                       quantity, price_per_item, discount_per_item, CAST(total_price AS DOUBLE) AS total_price
                FROM rowset WHERE total_price <> (price_per_item - discount_per_item) * quantity"""),
            "m2_product_reach": self("rowset", """
                SELECT product_id, COUNT(DISTINCT client_id) AS buyers, COUNT(DISTINCT purchase_date) AS active_days
                FROM rowset GROUP BY product_id"""),
            "m3_discount_units_correlation": self("item", f"""
                SELECT COUNT(*) AS products_count, {hu(corr('rate', 'qty'), 4)} AS discount_sales_correlation
                FROM (SELECT qty, {rate} AS rate FROM item)"""),
            "m4_core_split": self("segmented", f"""
                SELECT CASE WHEN xc = 'Z' THEN 'AAZ' ELSE 'AAX+AAY' END AS core, COUNT(*) AS products_count,
                       {hu(pct('SUM(rev)', 'MAX(rev_all)'), 2)} AS revenue_share_pct,
                       {hu(pct('SUM(qty)', 'MAX(qty_all)'), 2)} AS units_share_pct
                FROM segmented WHERE rc = 'A' AND qc = 'A' GROUP BY 1"""),
            "m5_frequency_tail": self("person", f"""
                SELECT CASE WHEN freq >= 9 THEN '9+' ELSE CAST(freq AS VARCHAR) END AS active_days,
                       COUNT(*) AS customers_count, {hu(share, 2)} AS customers_share_pct
                FROM person GROUP BY 1"""),
            "m6_dual_abc_shares": self("classed", f"""
                SELECT {joint}, {hu(share, 2)} AS products_share_pct,
                       {hu(pct('SUM(rev)', 'MAX(rev_all)'), 2)} AS revenue_share_pct,
                       {hu(pct('SUM(qty)', 'MAX(qty_all)'), 2)} AS units_share_pct
                FROM classed GROUP BY 1"""),
        }
        return out

    def listed_months(self, products: tuple) -> str:
        return self("rowset", f"""
            SELECT product_id, mon AS month, {big('SUM(quantity)')} AS units_sold, {hu('SUM(total_price)', 0)} AS revenue
            FROM rowset WHERE product_id IN {products} GROUP BY ALL ORDER BY 1, 2""")

    def blocks(self) -> dict[str, str]:
        return {
            "b01_base_sales": self("rowset", """
                SELECT client_id, purchase_date, product_id, quantity, CAST(total_price AS DOUBLE) AS total_price
                FROM rowset"""),
            "b02_product_metrics": self("item", f"""
                SELECT product_id, CAST(rev AS DOUBLE) AS revenue, {big('qty')} AS units_sold,
                       {big('gross')} AS gross_revenue, {big('disc')} AS discount_amount,
                       {pct('disc', 'gross')} AS discount_rate_pct
                FROM item"""),
            "b07_dense_monthly_units": self("grid", f"""
                SELECT product_id, mon AS month, {big('u')} AS units_sold FROM grid"""),
            "b09_product_segments": self("segmented", """
                SELECT product_id, rc || qc AS abc_class, xc AS xyz_class, seg AS segment FROM segmented"""),
            "b10_first_months": self("born", """
                SELECT client_id, d1 AS first_purchase_date, coh AS cohort_month FROM born JOIN person USING (client_id)"""),
            "b13_activity_cells": self("cell", f"""
                SELECT CAST(date_diff('month', {later(self.p.start, 0)}, coh) AS INTEGER) AS cohort,
                       CAST(k AS INTEGER) AS month_number, act AS active_clients, CAST(rev AS DOUBLE) AS revenue
                FROM cell"""),
            "b18_purchase_days": self("days", "SELECT client_id, d AS purchase_date FROM days"),
            "b20_client_segments": self("named", """
                SELECT client_id, concat(r, f, m) AS rfm_score, seg AS segment FROM named"""),
        }

    def records(self) -> dict[str, str]:
        """The snapshot lists, taken from the report texts."""
        t = self.reports()
        return {
            "abc_revenue": f"""
                SELECT abc_class AS class, products_count AS sku_count, products_share_pct AS sku_share_pct,
                       revenue_share_pct FROM ({t['a02_abc_summary']})""",
            "dual_abc": f"""
                SELECT abc_class AS segment, products_count AS sku_count, revenue, units_sold
                FROM ({t['a04_dual_abc_summary']})""",
            "purchase_frequency": f"""
                SELECT active_days, customers_count AS customer_count FROM ({t['m5_frequency_tail']})""",
            "rfm_segments": f"""
                SELECT segment, customers_share_pct AS customer_share_pct, revenue_share_pct
                FROM ({t['c06_rfm_segments']})""",
            "repeat_rate": t["c13_repeat_rate"],
            "cohort_metrics": f"""
                SELECT month_number, x.cohort_size AS initial_customers, x.retention_pct,
                       y.cumulative_revenue_per_customer AS cumulative_revenue_per_original_customer,
                       x.revenue_per_active_customer
                FROM ({t['c11_retention_revenue']}) x JOIN ({t['c10_ltv_fixed_cohorts']}) y USING (month_number)""",
        }

    def loads(self) -> dict[str, str]:
        delivery = """
            WITH delivery AS (
                SELECT *, CAST(ts AS DATE) AS own, CAST(ts + INTERVAL 1 HOUR AS DATE) AS sent FROM events)"""
        stored = """
            SELECT user_id AS client_id, substr(event_type, 1, 1) AS gender, own AS purchase_date,
                   CAST(date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + date_part('second', ts) AS INTEGER)
                       AS purchase_time_as_seconds_from_midnight,
                   CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS product_id, 1 AS quantity,
                   CAST(floor(value + 0.5) AS BIGINT) AS price_per_item, CAST(0 AS BIGINT) AS discount_per_item,
                   CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS total_price
            FROM delivery WHERE own = sent"""
        spoiled = " AND sent NOT IN (SELECT sent FROM delivery WHERE value = 0)"
        corrected = " AND event_type <> 'error' AND value <> 0"
        whole = delivery + stored + corrected
        stray = stored.replace("SELECT user_id", "SELECT sent AS date, '1' AS drop, user_id").replace("own = sent", "own <> sent")
        day = "DATE '2024-01-10'"
        published = delivery + stored + f" AND (sent = {day}{corrected} OR sent <> {day}{spoiled})"
        return {
            "snk2_published_day": published,
            "snk5_published": f"""
                SELECT MIN(purchase_date) AS min_date, MAX(purchase_date) AS max_date, COUNT(*) AS rows_count FROM ({published})""",
            "snk6_published": f"""
                SELECT purchase_date, COUNT(*) AS rows_count FROM ({published})
                WHERE purchase_date < DATE '2024-02-01' GROUP BY purchase_date""",
            "str1_split_drop": whole,
            "str1_late_older_drop": whole,
            "snk1_numeric_drops": whole,
            "src2_array_rows": delivery + stored + spoiled,
            "src5_load_day": delivery + stored + " AND sent = DATE '2024-01-10' AND event_type <> 'error' AND value <> 0",
            # Days with a bad redelivery keep the corrected rows, the others have all.
            "snk3_after_failed_redelivery": delivery + stored
            + " AND (sent NOT IN (SELECT sent FROM delivery WHERE value = 0) OR event_type <> 'error' AND value <> 0)",
            # Days without rows in the redelivery keep theirs.
            "snk3_after_empty_redelivery": delivery + stored + corrected
            + " AND (sent >= DATE '2024-01-15' OR event_type <> 'click')",
            "snk1_quarantined_rows": delivery + stray + spoiled,
            "src4_backfill_status": f"""{delivery},
                per AS (
                    SELECT sent, COUNT(*) AS n, CAST(COUNT_IF(own <> sent) AS BIGINT) AS stray, CAST(COUNT_IF(value = 0) AS BIGINT) AS bad
                    FROM delivery GROUP BY sent),
                cal AS (SELECT CAST(range AS DATE) AS date
                        FROM range(DATE '2024-01-01', DATE '2024-02-02', INTERVAL 1 DAY))
                SELECT date, COALESCE(n, 0) AS received,
                       CASE WHEN n IS NULL OR bad > 0 THEN 0 ELSE stray END AS quarantined,
                       CASE WHEN n IS NULL OR bad > 0 THEN 0 ELSE n - stray END AS loaded,
                       CASE WHEN n IS NULL THEN 'empty' WHEN bad > 0 THEN 'failed'
                            WHEN n = stray THEN 'quarantined' ELSE 'loaded' END AS status
                FROM cal LEFT JOIN per ON sent = date""",
            "snk1_loaded_rows": delivery + stored + spoiled,
            "snk1_replaced_rows": delivery + stored + corrected,
            "str1_streamed_rows": delivery + stored + corrected,
            "snk5_load_range": self("sales", """
                SELECT MIN(purchase_date) AS min_date, MAX(purchase_date) AS max_date, COUNT(*) AS rows_count
                FROM sales"""),
            "snk6_rows_per_day": self("rowset", """
                SELECT purchase_date, COUNT(*) AS rows_count FROM rowset GROUP BY purchase_date"""),
        }
