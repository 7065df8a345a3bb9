import os
import sys
from datetime import datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from published import SERIES_COLUMNS, published_path  # noqa: E402
from tidecast.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session


@pytest.fixture(scope="session")
def weekly_frame(spark):
    """Make a weekly table from {series: values}."""

    def make(values, start=datetime(2015, 1, 4), step=timedelta(days=7), columns="y double"):
        table = values if isinstance(values, dict) else {"s": values}
        rows = [
            (sid, start + step * i, None if v is None else float(v))
            for sid, vs in table.items()
            for i, v in enumerate(vs)
        ]
        return spark.createDataFrame(rows, f"series_id string, ts timestamp_ntz, {columns}")

    return make


@pytest.fixture(scope="session")
def hourly_frame(weekly_frame):
    def make(values, columns="y double"):
        return weekly_frame(values, datetime(2015, 1, 1), timedelta(hours=1), columns)

    return make


@pytest.fixture(scope="session")
def published_weekly(spark):
    """The published weekly series."""
    from pyspark.sql import functions as F

    from tidecast.sources.readers import read_series

    raw = read_series(spark, published_path(SERIES_COLUMNS), "csv")
    return raw.select("series_id", "ts", F.col("load_gw").alias("y")).cache()
