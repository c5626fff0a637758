from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postings_engine.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate an expression on a one-row table of the given columns."""
    def run(expression, **columns):
        df = spark.createDataFrame([tuple(columns.values()) or (1,)], list(columns) or ["x"]) \
            if all(v is not None for v in columns.values()) else spark.createDataFrame(
                [tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
        return df.select(expression.alias("v")).first()["v"]

    return run
