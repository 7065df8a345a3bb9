"""Mean, naive, seasonal-naive and drift forecasts of the test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalar import checked
from tidecast.operators.split import test_rows, train_rows
from tidecast.schema import SERIES, TS, Y

BASELINES = ("mean", "naive", "seasonal_naive", "drift")


def train_constants(split: DataFrame, target: str = Y, season: int | None = None) -> DataFrame:
    """One row per series: training mean, first, last, length and, if asked, the last season.

    The season is an array of at most ``season`` values.
    """
    aggregates = [
        F.avg(target).alias("train_mean"),
        F.min_by(target, "pos").alias("train_first"),
        F.max_by(target, "pos").alias("train_last"),
        F.count(target).alias("train_length"),
    ]
    if season:
        in_season = F.col("pos") > F.col("n_train") - season
        cells = F.collect_list(F.when(in_season, F.struct("pos", F.col(target).alias("value"))))
        aggregates.append(F.array_sort(cells)["value"].alias("last_season"))
    return train_rows(split).groupBy(SERIES).agg(*aggregates)


def baseline_forecasts(
    split: DataFrame, season: int = 52, target: str = Y, strict: bool = False
) -> DataFrame:
    """``series_id, ts, step, actual`` and one column per baseline."""
    joined = test_rows(split).join(train_constants(split, target, season), SERIES)
    step = F.col("step")
    slot = (F.pmod(step - 1, F.lit(season)) + 1).cast("int")
    seasonal = checked(
        F.col("train_length") >= season,
        F.try_element_at("last_season", slot),
        "the training rows do not fill one season",
        strict,
    )
    slope = (F.col("train_last") - F.col("train_first")) / F.nullif(
        F.col("train_length") - 1, F.lit(0)
    )
    drift = checked(
        F.col("train_length") >= 2,
        F.col("train_last") + slope * step,
        "a drift needs two training rows",
        strict,
    )
    return joined.select(
        SERIES,
        TS,
        "step",
        F.col(target).alias("actual"),
        F.col("train_mean").alias("mean"),
        F.col("train_last").alias("naive"),
        seasonal.alias("seasonal_naive"),
        drift.alias("drift"),
    )


def align_steps(split: DataFrame, forecasts: DataFrame, target: str = Y) -> DataFrame:
    """Put step-numbered forecasts on the test rows' timestamps."""
    tests = test_rows(split).select(SERIES, TS, "step", F.col(target).alias("actual"))
    return tests.join(forecasts, [SERIES, "step"], "left")
