"""Calendar, lag, rolling and difference columns. Every lag counts rows, not calendar time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidecast.functions.scalar import checked, cycle_angle
from tidecast.operators.layout import over_series, positions
from tidecast.schema import (
    ROLLING_WINDOWS,
    SERIES,
    TARGET_LAGS,
    TS,
    WEATHER_COLUMNS,
    Y,
    require_columns,
)


def calendar(df: DataFrame) -> DataFrame:
    """ISO week with month, quarter and calendar year, and the week as a point on a circle."""
    t = F.col(TS)
    week = F.weekofyear(t)
    return df.withColumns(
        {
            "week_of_year": week,
            "month": F.month(t),
            "quarter": F.quarter(t),
            "year": F.year(t),
            "week_sin": F.sin(cycle_angle(week)),
            "week_cos": F.cos(cycle_angle(week)),
        }
    )


def lag_columns(w: WindowSpec, target: str, lags: Sequence[int]) -> dict[str, Column]:
    return {f"load_lag_{k}": F.lag(target, k).over(w) for k in lags}


def rolling_columns(w: WindowSpec, target: str, windows: Sequence[int]) -> dict[str, Column]:
    """Mean and sample deviation of the ``k`` rows before the current one, if all are present."""
    out: dict[str, Column] = {}
    for k in windows:
        frame = w.rowsBetween(-k, -1)
        full = F.count(target).over(frame) == k
        out[f"load_rolling_mean_{k}"] = F.when(full, F.avg(target).over(frame))
        out[f"load_rolling_std_{k}"] = F.when(full, F.stddev_samp(target).over(frame))
    return out


def weather_columns(w: WindowSpec, columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in (1, 2)}


def target_lags(
    df: DataFrame, target: str = Y, lags: Sequence[int] = TARGET_LAGS, grain: str = "week"
) -> DataFrame:
    require_columns(df, [target])
    return over_series(df, lambda w: lag_columns(w, target, lags), max(lags), grain)


def rolling_features(
    df: DataFrame, target: str = Y, windows: Sequence[int] = ROLLING_WINDOWS, grain: str = "week"
) -> DataFrame:
    require_columns(df, [target])
    return over_series(df, lambda w: rolling_columns(w, target, windows), max(windows), grain)


def weather_lags(df: DataFrame, grain: str = "week") -> DataFrame:
    """Lags 1 and 2 of the weather columns that are there."""
    present = [c for c in WEATHER_COLUMNS if c in df.columns]
    if not present:
        return df
    return over_series(df, lambda w: weather_columns(w, present), 2, grain)


def feature_table(
    df: DataFrame,
    target: str = Y,
    lags: Sequence[int] = TARGET_LAGS,
    windows: Sequence[int] = ROLLING_WINDOWS,
    grain: str = "week",
) -> DataFrame:
    """The supervised table: calendar, lags, rolling and weather lags, complete rows only.

    All window columns share one window, so the plan has one shuffle and one sort.
    """
    require_columns(df, [SERIES, TS, target])
    present = [c for c in WEATHER_COLUMNS if c in df.columns]

    def columns(w: WindowSpec) -> dict[str, Column]:
        return (
            lag_columns(w, target, lags)
            | rolling_columns(w, target, windows)
            | weather_columns(w, present)
        )

    full = over_series(df, columns, max([*lags, *windows, 2]), grain)
    return calendar(full).na.drop("any")


def differences(df: DataFrame, season: int = 52, target: str = Y, grain: str = "week") -> DataFrame:
    """First, seasonal, and first-then-seasonal difference."""
    y = F.col(target)

    def columns(w: WindowSpec) -> dict[str, Column]:
        first = y - F.lag(target, 1).over(w)
        before = F.lag(target, season).over(w) - F.lag(target, season + 1).over(w)
        return {
            "first_difference": first,
            "seasonal_difference": y - F.lag(target, season).over(w),
            "first_seasonal_difference": first - before,
        }

    return over_series(df, columns, season + 1, grain)


def sequences(
    df: DataFrame, length: int, target: str = Y, grain: str = "hour", strict: bool = False
) -> DataFrame:
    """The previous ``length`` values as an array, for every row that has that many before it.

    Strict: a series of ``length`` rows or fewer is an error.
    """
    if strict:
        placed = df if {"pos", "n"} <= set(df.columns) else positions(df, grain)
        message = "the series is too short for a single sequence"
        df = placed.withColumn(target, checked(F.col("n") > length, F.col(target), message, True))

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {"sequence": F.collect_list(target).over(w.rowsBetween(-length, -1))}

    return over_series(df, columns, length, grain).filter(F.size("sequence") == length)


def best_row(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (SERIES,)) -> DataFrame:
    """First row per key in the given order; candidates per key are a small grid."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
