"""Classes cut from a number by ascending, inclusive upper bounds."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Customer segment rules in order (first match wins) with their names.
# Each rule lists the allowed scores of recency, frequency and monetary value.
ANY = (1, 2, 3, 4, 5)
SEGMENT_RULES = (
    ((4, 5), (4, 5), (4, 5), "best", "Лучшие клиенты"),
    ((3, 4, 5), (4, 5), (3, 4, 5), "loyal", "Лояльные"),
    ((4, 5), (2, 3), (2, 3, 4, 5), "promising", "Перспективные"),
    ((5,), (1,), ANY, "new", "Новые"),
    ((4, 5), (1, 2), ANY, "active_low_frequency", "Активные низкой частоты"),
    ((3,), ANY, ANY, "needs_attention", "Требуют внимания"),
    ((1, 2), (4, 5), (3, 4, 5), "at_risk", "Под риском"),
    ((1, 2), ANY, (4, 5), "valuable_reactivate", "Ценные, требуют реактивации"),
    ((1, 2), ANY, (3,), "leaving", "Уходящие"),
    ((1, 2), (1, 2), (1, 2), "sleeping", "Спящие"),
)
OTHER_SEGMENT = ("other", "Остальные")


def band(value: Column, cuts, labels) -> Column:
    """labels[i] for the first cut with value <= cut, the last label otherwise.

    NULL is not below any cut, so it also gets the last label.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("one label more than cuts is needed")
    first, *rest = zip(cuts, labels)
    out = F.when(value <= F.lit(first[0]), F.lit(first[1]))
    for cut, label in rest:
        out = out.when(value <= F.lit(cut), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def rfm_segment(r: Column, f: Column, m: Column, language: str) -> Column:
    name = {"en": 0, "ru": 1}[language]
    pieces = [(r, 0), (f, 1), (m, 2)]
    chain = F
    for rule in SEGMENT_RULES:
        hit = F.lit(True)
        for column, position in pieces:
            if rule[position] != ANY:
                hit = hit & column.isin(*rule[position])
        chain = chain.when(hit, F.lit(rule[3 + name]))
    return chain.otherwise(F.lit(OTHER_SEGMENT[name]))


def discount_band_label(lower: Column, width: int) -> Column:
    """'5–10%'; parts of an unknown band are left out, so it reads '–%'."""
    return F.concat_ws(
        "",
        lower.cast("int").cast("string"),
        F.lit("–"),
        (lower + width).cast("int").cast("string"),
        F.lit("%"),
    )


def exact(number) -> Column:
    """A threshold as an exact decimal literal."""
    return F.lit(Decimal(str(number)))
