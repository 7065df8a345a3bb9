"""Coercion, de-duplication and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalar import coerce_double, coerce_timestamp, is_finite
from tidecast.schema import SERIES, START_DATE, TS, Y, require_columns


def keep_first(df: DataFrame, values: Sequence[str], order: str) -> DataFrame:
    """One row per ``(series_id, ts)``: the one with the smallest ``order``, missing values included.

    Written as an aggregate, so copies are merged before the shuffle and a timestamp that holds a
    large share of all rows never gathers in one task.
    """
    return df.groupBy(SERIES, TS).agg(*[F.min_by(v, order).alias(v) for v in values])


def from_start(df: DataFrame, start: str = START_DATE) -> DataFrame:
    return df.filter(F.col(TS) >= F.lit(start).cast("timestamp_ntz"))


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL or NaN in the subset, or in any column."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def finite_only(df: DataFrame, column: str = Y) -> DataFrame:
    return df.filter(is_finite(F.col(column)))


def coerce_load(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Raw text to typed columns; bad cells become NULL."""
    require_columns(df, ["timestamp", "load_mw", order])
    return df.select(
        F.col(SERIES) if SERIES in df.columns else F.lit("s").alias(SERIES),
        coerce_timestamp(F.col("timestamp")).alias(TS),
        coerce_double(F.col("load_mw")).alias("load_mw"),
        order,
    )


def clean_load(
    df: DataFrame,
    start: str = START_DATE,
    divisor: float = 1000.0,
    order: str = "ingest_seq",
) -> DataFrame:
    """Hourly load in GW.

    Order of steps is part of the result: the first row of a timestamp is chosen before missing
    loads are dropped, so a missing first copy removes the hour.
    """
    typed = drop_missing(coerce_load(df, order), [TS])
    first = keep_first(from_start(typed, start), ["load_mw"], order)
    scaled = first.select(SERIES, TS, (F.col("load_mw") / F.lit(divisor)).alias(Y))
    return drop_missing(scaled, [Y])
