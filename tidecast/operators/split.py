"""Chronological splits, folds and scaling fitted on the training part only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalar import checked
from tidecast.operators.layout import join_series, positions
from tidecast.schema import SERIES, Y


def split_last(
    df: DataFrame,
    horizon: int,
    target: str = Y,
    grain: str = "week",
    strict: bool = False,
) -> DataFrame:
    """Mark the last ``horizon`` rows of each series as test.

    Adds ``pos, n, n_train, role, step``. A series with no training row gets a NULL role, or an
    error when strict. Missing targets are dropped first.
    """
    placed = positions(df.na.drop(subset=[target]), grain)
    train_rows = F.col("n") - F.lit(horizon)
    role = F.when(F.col("pos") > train_rows, "test").otherwise("train")
    return placed.withColumns(
        {
            "n_train": train_rows,
            "role": checked(
                train_rows > 0,
                role,
                "every row would be a test row: the series is not longer than the horizon",
                strict,
            ),
            "step": F.when(F.col("pos") > train_rows, F.col("pos") - train_rows),
        }
    )


def train_rows(split: DataFrame) -> DataFrame:
    return split.filter(F.col("role") == "train")


def test_rows(split: DataFrame) -> DataFrame:
    return split.filter(F.col("role") == "test")


def expanding_folds(df: DataFrame, splits: int = 4) -> DataFrame:
    """Fold table over rows with ``pos`` and ``n``.

    The validation block of fold i is the i-th of the last ``splits`` blocks of n // (splits + 1)
    rows; everything before it trains.
    """
    size = F.floor(F.col("n") / F.lit(splits + 1))
    cut = F.col("n") - size * (F.lit(splits + 1) - F.col("fold"))
    folds = F.explode(F.sequence(F.lit(1), F.lit(splits)))
    return (
        df.withColumn("fold", folds)
        .withColumn(
            "fold_role",
            F.when(F.col("pos") <= cut, "train").when(F.col("pos") <= cut + size, "validation"),
        )
        .filter(F.col("fold_role").isNotNull())
    )


def validation_tail(
    df: DataFrame, fraction: float = 0.15, strict: bool = False
) -> DataFrame:
    """Mark the last int(fraction * n) rows as validation; needs ``pos`` and ``n``."""
    size = F.floor(F.col("n") * F.lit(fraction))
    part = F.when(F.col("pos") > F.col("n") - size, "validation").otherwise("train")
    return df.withColumn(
        "part",
        checked(size >= 1, part, "the validation part is empty", strict),
    )


def column_scales(split: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Training mean and sample deviation of every column, one row per series."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return train_rows(split).groupBy(SERIES).agg(*stats)


def _nonzero(std: Column, name: str, strict: bool) -> Column:
    return checked(std != 0, std, f"column {name} is constant over the training rows", strict)


def standardise(
    split: DataFrame, columns: Sequence[str], strict: bool = False, suffix: str = "_scaled"
) -> DataFrame:
    """(x - mean) / std with training statistics; a constant column gives NULL or an error."""
    joined = join_series(split, column_scales(split, columns), how="left")
    scaled = {
        f"{c}{suffix}": (F.col(c) - F.col(f"{c}_mean")) / _nonzero(F.col(f"{c}_std"), c, strict)
        for c in columns
    }
    helpers = [f"{c}_{s}" for c in columns for s in ("mean", "std")]
    return joined.withColumns(scaled).drop(*helpers)


def scaling_table(split: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form of the training scales: one row per series and variable."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.col(f"{c}_mean").alias("training_mean"),
                F.col(f"{c}_std").alias("training_standard_deviation"),
            )
            for c in columns
        ]
    )
    return column_scales(split, columns).select(SERIES, F.inline(rows))


def range_scales(split: DataFrame, target: str = Y) -> DataFrame:
    """Training minimum and range; a constant series keeps a range of 1."""
    low, high = F.min(target), F.max(target)
    return (
        train_rows(split)
        .groupBy(SERIES)
        .agg(
            low.alias("scale_min"),
            F.when(high == low, F.lit(1.0)).otherwise(high - low).alias("scale_range"),
        )
    )


def scale_range(
    split: DataFrame, target: str = Y, output: str = "scaled", scales: DataFrame | None = None
) -> DataFrame:
    """Map the training range to 0..1; later values may lie outside."""
    scales = range_scales(split, target) if scales is None else scales
    joined = join_series(split, scales, how="left")
    return joined.withColumn(output, (F.col(target) - F.col("scale_min")) / F.col("scale_range"))


def unscale(value: Column) -> Column:
    return value * F.col("scale_range") + F.col("scale_min")
