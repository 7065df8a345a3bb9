"""Column names of the long table and the checks made on a schema before planning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = "series_id"
TS = "ts"
Y = "y"

# Defaults of the weekly and hourly studies.
START_DATE = "2015-01-01"
WEEKLY_HORIZON = 104
WEEKLY_SEASON = 52
HOURLY_HORIZON = 17520
SEQUENCE_LENGTH = 168
SEED = 42
DEGREE_DAY_BASE = 18.0
TARGET_LAGS = (1, 2, 4, 12, 52)
ROLLING_WINDOWS = (4, 12, 52)
WEATHER_COLUMNS = (
    "temp_mean",
    "temp_min",
    "temp_max",
    "heating_degree_days",
    "cooling_degree_days",
)
TIMESTAMP_COLUMN = "utc_timestamp"
LOAD_COLUMNS = (
    "DE_load_actual_entsoe_transparency",
    "DE_load_actual_entsoe_power_statistics",
)
LOAD_PREFIX = "DE_"
LOAD_NEEDLE = "load_actual"


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df


def require_timestamp(df: DataFrame, column: str = TS) -> DataFrame:
    require_columns(df, [column])
    if not isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"Column {column!r} must be a timestamp")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail on an empty result. Runs a job, so call it on small or stored tables."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty.")
    return df


def resolve_column(
    columns: Sequence[str],
    candidates: Sequence[str] = LOAD_COLUMNS,
    prefix: str = LOAD_PREFIX,
    needle: str = LOAD_NEEDLE,
) -> str:
    """The first named candidate present, else the first column matching prefix and needle."""
    for name in candidates:
        if name in columns:
            return name
    prefixed = [c for c in columns if c.startswith(prefix)]
    for name in prefixed:
        if needle in name:
            return name
    raise ValueError(f"No load column found. Columns starting {prefix!r}: {prefixed}")


def predictors(df: DataFrame, target: str = Y, keys: Sequence[str] = (SERIES, TS)) -> list[str]:
    """Every column but the keys and the target."""
    return [c for c in df.columns if c != target and c not in keys]


def to_long(df: DataFrame, series: str, ts: str, y) -> DataFrame:
    """Rename the columns of any table to the long form; ``y`` may be a name or a Column."""
    value = F.col(y) if isinstance(y, str) else y
    return df.select(
        F.col(series).cast("string").alias(SERIES),
        F.col(ts).cast("timestamp_ntz").alias(TS),
        value.cast("double").alias(Y),
    )
