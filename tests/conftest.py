from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tradewind.plans.session import session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def in_order(data):
    return sorted(data, key=lambda row: tuple(str(value) for value in row))


def rows(frame):
    """Rows as tuples, sorted."""
    return in_order(tuple(r) for r in frame.collect())
