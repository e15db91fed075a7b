"""Every report by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from cartlens.operators.shared import SharedSales
from cartlens.params import Params
from cartlens.plans import assortment, customers, metrics

Report = Callable[[DataFrame, Params], DataFrame]

REPORTS: dict[str, Report] = {
    name: function
    for module in (assortment, customers, metrics)
    for name, function in vars(module).items()
    if re.match(r"[acm]\d+_", name) and getattr(function, "__module__", None) == module.__name__
}


def report(name: str, sales: DataFrame | SharedSales, params: Params | None = None) -> DataFrame:
    if name not in REPORTS:
        raise KeyError(f"unknown report {name!r}; known: {', '.join(sorted(REPORTS))}")
    return REPORTS[name](sales, params or Params())


def register_views(sales: DataFrame | SharedSales, params: Params | None = None, names=None) -> list[str]:
    """Make reports selectable in SQL under their names. Returns the names.

    The reports share their blocks, which are computed here.
    """
    sales = sales if isinstance(sales, SharedSales) else SharedSales(sales)
    names = sorted(names or REPORTS)
    for name in names:
        report(name, sales, params).createOrReplaceTempView(name)
    return names
