"""Forecast errors, scaled errors, and the tables that compare models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.scalar import checked, guarded_scale, improvement_percent
from tidecast.operators.features import best_row
from tidecast.operators.layout import over_series
from tidecast.operators.resample import weekly_mean
from tidecast.operators.split import train_rows
from tidecast.schema import SERIES, TS, Y, require_columns

KEYS = (SERIES, TS, "step", "actual", "lower_95", "upper_95")
METRICS = ("MAE", "RMSE", "MASE", "Bias")


def mae(actual: Column, forecast: Column) -> Column:
    return F.avg(F.abs(forecast - actual))


def rmse(actual: Column, forecast: Column) -> Column:
    return F.sqrt(F.avg(F.pow(forecast - actual, F.lit(2.0))))


def bias(actual: Column, forecast: Column) -> Column:
    """Mean forecast minus actual: positive is over-forecasting."""
    return F.avg(forecast - actual)


def model_columns(forecasts: DataFrame, keys: Sequence[str] = KEYS) -> list[str]:
    return [c for c in forecasts.columns if c not in keys]


def error_metrics(
    forecasts: DataFrame,
    models: Sequence[str] | None = None,
    by: Sequence[str] = (SERIES,),
    strict: bool = False,
    counts: bool = False,
) -> DataFrame:
    """MAE, RMSE and Bias of every model column.

    A model is scored on all rows with an actual value or not at all: one missing forecast makes
    its metrics NULL (strict: an error). ``counts`` adds the ``expected`` and ``scored`` rows. The
    wide table is aggregated as it is; only the few result cells are turned into rows.
    """
    require_columns(forecasts, ["actual"])
    names = list(models or model_columns(forecasts))
    actual = F.col("actual")

    def cell(m: str) -> Column:
        forecast = F.col(f"`{m}`")
        expected, scored = F.count(actual), F.count(actual + forecast)
        metrics = {"MAE": mae, "RMSE": rmse, "Bias": bias}
        message = f"Model {m} lacks forecasts for some of the evaluated rows."
        whole = [
            checked(scored == expected, metric(actual, forecast), message, strict).alias(name)
            for name, metric in metrics.items()
        ]
        sizes = [expected.alias("expected"), scored.alias("scored")] if counts else []
        return F.struct(F.lit(m).alias("model"), *whole, *sizes)

    cells = F.array(*[cell(m) for m in names])
    return forecasts.groupBy(*by).agg(cells.alias("_cells")).select(*by, F.inline("_cells"))


def mase_scale(
    split: DataFrame,
    season: int = 52,
    target: str = Y,
    grain: str = "week",
    strict: bool = False,
) -> DataFrame:
    """In-sample mean absolute seasonal difference, one row per series."""
    lagged = over_series(
        split, lambda w: {"_before": F.lag(target, season).over(w)}, season, grain
    )
    scales = (
        train_rows(lagged)
        .groupBy(SERIES)
        .agg(
            F.avg(F.abs(F.col(target) - F.col("_before"))).alias("_scale"),
            F.count(target).alias("_rows"),
        )
    )
    long_enough = checked(
        F.col("_rows") > season,
        F.col("_scale"),
        "the training rows do not reach past one season",
        strict,
    )
    return scales.select(SERIES, guarded_scale(long_enough, strict).alias("mase_scale"))


def evaluate(
    forecasts: DataFrame,
    split: DataFrame,
    season: int = 52,
    models: Sequence[str] | None = None,
    grain: str = "week",
    strict: bool = False,
) -> DataFrame:
    """``series_id, model, MAE, RMSE, MASE, Bias`` for every model column."""
    errors = error_metrics(forecasts, models, strict=strict)
    scales = mase_scale(split, season, grain=grain, strict=strict)
    return errors.join(scales, SERIES, "left").select(
        SERIES,
        "model",
        "MAE",
        "RMSE",
        (F.col("MAE") / F.col("mase_scale")).alias("MASE"),
        "Bias",
    )


def rank_models(metrics: DataFrame, by: str = "RMSE") -> DataFrame:
    """Order models of a series by a score; the name breaks ties. A series has few models."""
    w = Window.partitionBy(SERIES).orderBy(F.col(by).asc_nulls_last(), "model")
    return metrics.withColumn("rank", F.row_number().over(w))


def weekly_forecasts(hourly: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Weekly means of an hourly forecast table, complete rows only."""
    require_columns(hourly, columns)
    return weekly_mean(hourly, columns)


def sequence_weekly_metrics(
    weekly: DataFrame,
    benchmark: DataFrame,
    forecast: str = "lstm",
    model: str = "lstm_weekly",
) -> DataFrame:
    """Weekly errors of an hourly model on the benchmark weeks.

    Its MASE divides by the seasonal-naive error of the *test* period, unlike ``mase_scale``.
    """
    weeks = benchmark.select(SERIES, TS, F.col("actual").alias("actual_benchmark"))
    errors = error_metrics(
        weekly.join(weeks, [SERIES, TS]).select(SERIES, TS, "actual", F.col(forecast).alias(model)),
        [model],
    )
    scale = benchmark.groupBy(SERIES).agg(
        mae(F.col("actual"), F.col("seasonal_naive")).alias("_scale")
    )
    return errors.join(scale, SERIES, "left").select(
        SERIES,
        "model",
        "MAE",
        "RMSE",
        (F.col("MAE") / F.nullif(F.col("_scale"), F.lit(0.0))).alias("MASE"),
        "Bias",
    )


def tag(metrics: DataFrame, frequency: str, forecast_type: str) -> DataFrame:
    return metrics.withColumns(
        {"frequency": F.lit(frequency), "forecast_type": F.lit(forecast_type)}
    )


def union_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; a column a table lacks is missing in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def compare_models(
    metrics: DataFrame, reference: str = "seasonal_naive", strict: bool = False
) -> DataFrame:
    """Improvement of every model over the reference model of its series, in percent."""
    base = best_row(
        metrics.filter(F.col("model") == reference).select(
            SERIES, F.col("RMSE").alias("_rmse"), F.col("MAE").alias("_mae")
        ),
        [F.col("_rmse")],
    )
    joined = metrics.join(base, SERIES, "left")
    known = checked(
        F.col("_rmse").isNotNull(), F.col("_rmse"), "The reference model is missing.", strict
    )
    return joined.withColumns(
        {
            "RMSE_improvement_percent": improvement_percent(known, F.col("RMSE")),
            "MAE_improvement_percent": improvement_percent(F.col("_mae"), F.col("MAE")),
        }
    ).drop("_rmse", "_mae")


def combine_forecasts(benchmark: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join forecast tables onto the benchmark weeks; all share the key ``(series_id, ts)``."""
    combined = benchmark
    for table in others:
        combined = combined.join(table, [SERIES, TS], "left")
    return combined


def combine_long(tables: Sequence[DataFrame], models: Sequence[str]) -> DataFrame:
    """The same table from long forecasts ``series_id, ts, model, forecast``, with one shuffle."""
    return union_tables(*tables).groupBy(SERIES, TS).pivot("model", list(models)).agg(
        F.first("forecast", ignorenulls=True)
    )
