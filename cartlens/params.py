"""Everything an analyst may tune, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Params:
    # Analysis period (end excluded) and thresholds of the study.
    start: date = date(2023, 1, 1)
    end: date = date(2024, 1, 1)
    abc_cuts: tuple = (80, 95)
    xyz_cuts: tuple = (55, 75)
    xyz_classic_cuts: tuple = (10, 25)
    recency_cuts: tuple = (33, 81, 135, 214)
    frequency_cuts: tuple = (1, 2, 3, 4)
    monetary_cuts: tuple = (341150, 937152, 1812834, 3267837)
    repeat_windows: tuple = (30, 60, 90)
    uplifts_pp: tuple = (0, 1, 3, 5)
    fixed_cohorts: int = 6
    fixed_horizon: int = 6
    discount_band: int = 5
    review_segment: str = "CCZ"
    review_max_revenue: float = 3401900
    review_max_units: int = 810
    review_min_cv: float = 95.12
    candidate_ids: tuple = (45201, 16635, 37382, 5702, 26800)
    # Language of the customer segment names: "ru" or "en".
    segment_language: str = "ru"
    # Rows of one slice where a global order is needed, each sorted by one task.
    rows_per_slice: int = 100_000

    def __post_init__(self):
        if self.start >= self.end:
            raise ValueError("start must lie before end")

    @property
    def first_month(self) -> date:
        return self.start.replace(day=1)

    @property
    def last_month(self) -> date:
        return (self.end - timedelta(days=1)).replace(day=1)

    @property
    def n_months(self) -> int:
        a, b = self.first_month, self.last_month
        return (b.year - a.year) * 12 + b.month - a.month + 1

    def index_of(self, month: date) -> int:
        """How many months after the first one a month begins."""
        return (month.year - self.first_month.year) * 12 + month.month - self.first_month.month

    def month_start(self, index: int) -> date:
        """First day of the month `index` months after the first one."""
        total = self.first_month.year * 12 + self.first_month.month - 1 + index
        return date(total // 12, total % 12 + 1, 1)
