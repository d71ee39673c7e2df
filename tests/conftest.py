from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dialweave.session import get_spark  # noqa: E402
from dialweave.sources import TABLES, Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows given as dicts, as a full table of the registry."""

    def build(name, rows):
        struct = TABLES[name].struct
        return spark.createDataFrame([tuple(r.get(c) for c in struct.names) for r in rows], struct)

    return build


@pytest.fixture
def make_tables(frame):
    """Tables from lists of dicts; tables not given are empty."""

    def build(**rows):
        return Tables(**{name: frame(name, rows.get(name, [])) for name in TABLES})

    return build


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def values(df, *columns):
    """Rows as plain tuples, in the frame's order."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
