from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cartlens.session import build_session  # noqa: E402
from cartlens.sources.schema import SALES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_sales(spark):
    """Sales rows from short tuples or dicts; unnamed columns are NULL."""

    def make(rows):
        full = []
        for row in rows:
            if not isinstance(row, dict):
                row = dict(zip(("client_id", "purchase_date", "quantity", "total_price"), row))
            row = dict(row)
            if isinstance(row.get("purchase_date"), str):
                row["purchase_date"] = date.fromisoformat(row["purchase_date"])
            if row.get("total_price") is not None:
                row["total_price"] = Decimal(str(row["total_price"]))
            full.append(tuple(row.get(name) for name in SALES.names))
        return spark.createDataFrame(full, SALES)

    return make


# The hand-made retention rows: period edges, unusable quantities, two lines on one day.
RETENTION_ROWS = [
    (101, "2023-01-10", 1, 100),
    (101, "2023-01-10", 1, 40),
    (102, "2023-01-20", 1, 200),
    (101, "2023-03-05", 1, 60),
    (101, "2023-07-10", 1, 40),
    (201, "2023-02-05", 1, 80),
    (301, "2023-06-15", 1, 120),
    (301, "2023-07-15", 1, 30),
    (401, "2023-07-01", 1, 900),
    (501, "2023-12-05", 1, 500),
    (101, "2022-12-31", 1, 9999),
    (888, "2024-01-05", 1, 9999),
    (777, "2023-02-10", 0, 9999),
    (778, "2023-02-15", -1, -50),
    (101, "2023-02-10", 0, 9999),
]


@pytest.fixture(scope="session")
def retention(make_sales):
    return make_sales(RETENTION_ROWS).cache()
