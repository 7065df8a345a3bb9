"""Calendar aggregation and weather features.

All of it is ``groupBy`` with partial aggregation: what is shuffled is one row per series, period
and input partition, however many rows a series has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalar import GRAINS, cooling, heating
from tidecast.schema import DEGREE_DAY_BASE, SERIES, TS, Y, require_columns, require_timestamp


def resample_mean(df: DataFrame, grain: str, columns: Sequence[str] = (Y,)) -> DataFrame:
    """Mean per series and hour, day or week (label: Sunday). Periods with no value are dropped."""
    require_columns(df, [SERIES, *columns])
    require_timestamp(df)
    means = df.groupBy(SERIES, GRAINS[grain](F.col(TS)).alias(TS)).agg(
        *[F.avg(c).alias(c) for c in columns]
    )
    return means.na.drop("any", subset=list(columns))


def daily_mean(df: DataFrame, columns: Sequence[str] = (Y,)) -> DataFrame:
    return resample_mean(df, "day", columns)


def weekly_mean(df: DataFrame, columns: Sequence[str] = (Y,)) -> DataFrame:
    return resample_mean(df, "week", columns)


def daily_parts(df: DataFrame, value: str) -> DataFrame:
    """Per-day sums that both the weekly statistics and the degree days are built from."""
    require_columns(df, [SERIES, value])
    require_timestamp(df)
    v = F.col(value)
    return df.groupBy(SERIES, GRAINS["day"](F.col(TS)).alias(TS)).agg(
        F.sum(v).alias("total"),
        F.count(v).alias("present"),
        F.avg(v).alias("daily_value"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    )


def weekly_stats(df: DataFrame, value: str = "temperature_2m") -> DataFrame:
    """Weekly mean, minimum and maximum."""
    return (
        df.groupBy(SERIES, GRAINS["week"](F.col(TS)).alias(TS))
        .agg(
            F.avg(value).alias("temp_mean"),
            F.min(value).alias("temp_min"),
            F.max(value).alias("temp_max"),
        )
        .na.drop("any")
    )


def degree_days(
    df: DataFrame, value: str = "temperature_2m", base: float = DEGREE_DAY_BASE
) -> DataFrame:
    """Weekly sums of daily heating and cooling degrees; a day counts by its mean."""
    daily = df.groupBy(SERIES, GRAINS["day"](F.col(TS)).alias(TS)).agg(
        F.avg(value).alias("daily_value")
    )
    return (
        daily.groupBy(SERIES, GRAINS["week"](F.col(TS)).alias(TS))
        .agg(
            F.sum(heating(F.col("daily_value"), base)).alias("heating_degree_days"),
            F.sum(cooling(F.col("daily_value"), base)).alias("cooling_degree_days"),
        )
        .na.drop("any")
    )


def weekly_weather(
    df: DataFrame, value: str = "temperature_2m", base: float = DEGREE_DAY_BASE
) -> DataFrame:
    """The five weekly weather columns in one scan.

    Weekly mean, extremes and degree days all follow from the same daily row, so the two weekly
    tables need no join. The weekly mean stays the mean of the readings, not of the days.
    """
    day = F.col("daily_value")
    return (
        daily_parts(df, value)
        .groupBy(SERIES, GRAINS["week"](F.col(TS)).alias(TS))
        .agg(
            (F.sum("total") / F.sum("present")).alias("temp_mean"),
            F.min("low").alias("temp_min"),
            F.max("high").alias("temp_max"),
            F.sum(heating(day, base)).alias("heating_degree_days"),
            F.sum(cooling(day, base)).alias("cooling_degree_days"),
        )
        .na.drop("any")
    )


def join_weather(left: DataFrame, right: DataFrame) -> DataFrame:
    """Weekly temperatures with the degree days of the same week, where known."""
    return left.join(right, [SERIES, TS], "left")


def model_table(load: DataFrame, weather: DataFrame) -> DataFrame:
    """Load and weather of the weeks present in both. Weather without series serves every series.

    Two weather rows for one key are an error at run time: they would multiply the load.
    """
    keys = [SERIES, TS] if SERIES in weather.columns else [TS]
    message = "the weather table holds several rows for one series and time"
    values = [
        F.when(F.count(F.lit(1)) == 1, F.first(c)).otherwise(F.raise_error(F.lit(message))).alias(c)
        for c in weather.columns
        if c not in keys
    ]
    return load.join(weather.groupBy(*keys).agg(*values), keys, "inner").na.drop("any")
