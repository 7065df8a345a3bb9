"""Row positions, windows and blocks that do not depend on how long one series is.

A weekly or daily table holds at most one row per series and calendar day, so the timestamp type
itself bounds a series and a window per series is safe. An hourly or finer table is cut:

* positions come from a histogram of time buckets (a small aggregate), its running sum, and a row
  number inside each bucket;
* windows run over chunks of consecutive positions, each carrying a copy of the rows its first
  windows look back to;
* numeric work gets the same chunks as arrays, one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidecast.schema import SERIES, TS, Y

CHUNK = 4096

# Parts that the rows of one series are dealt into for a join with one row per series.
SPREAD = 64

DAY = 86_400

# Seconds per time bucket; None means one window per series. With one row per time step a bucket
# holds at most 672, 1,440, 3,600 or 60,000 rows.
BUCKET_SECONDS = {
    "week": None,
    "day": None,
    "hour": 28 * DAY,
    "minute": DAY,
    "second": DAY // 24,
    "millisecond": 60,
}


def series_window() -> WindowSpec:
    return Window.partitionBy(SERIES).orderBy(TS)


def time_bucket(seconds: int) -> Column:
    """Number of the stretch of ``seconds`` that a row's time lies in."""
    inside = F.hour(TS) * 3600 + F.minute(TS) * 60 + F.second(TS)
    since = F.unix_date(F.to_date(TS)).cast("long") * DAY + inside
    return F.floor(since / F.lit(seconds))


def positions(df: DataFrame, grain: str = "week") -> DataFrame:
    """Add ``pos`` (1, 2, ... by time within the series) and ``n`` (rows of the series).

    ``grain`` is the finest step of the times; it decides how finely a series is cut, never the result.
    """
    seconds = BUCKET_SECONDS[grain]
    if seconds is None:
        return df.withColumns(
            {
                "pos": F.row_number().over(series_window()).cast("long"),
                "n": F.count(F.lit(1)).over(Window.partitionBy(SERIES)),
            }
        )
    bucketed = df.withColumn("_bucket", time_bucket(seconds))
    counts = bucketed.groupBy(SERIES, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    past = Window.partitionBy(SERIES).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        SERIES,
        "_bucket",
        F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(SERIES)).alias("n"),
    )
    inside = Window.partitionBy(SERIES, "_bucket").orderBy(TS)
    # Numbered before the join: narrower rows are shuffled, and the join finds them placed.
    return (
        bucketed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [SERIES, "_bucket"])
        .withColumn("pos", F.col("_inside") + F.col("_before"))
        .drop("_bucket", "_before", "_inside")
    )


def with_halo(df: DataFrame, lookback: int | Column, chunk: int = CHUNK) -> DataFrame:
    """Assign rows to chunks of ``chunk`` positions and copy each chunk's lookback into it.

    Adds ``_chunk`` and ``_start``; a row belongs to its chunk when ``pos > _start`` and is only
    history otherwise. Needs ``pos`` and ``n``.
    """
    index = F.col("pos") - 1
    first = F.floor(index / F.lit(chunk))
    reach = F.floor((index + lookback) / F.lit(chunk))
    last = F.least(reach, F.floor((F.col("n") - 1) / F.lit(chunk)))
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_start", F.col("_chunk") * F.lit(chunk)
    )


def over_series(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column]],
    lookback: int,
    grain: str = "week",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add window columns that look at most ``lookback`` rows back within the series."""
    if BUCKET_SECONDS[grain] is None:
        return df.withColumns(columns(series_window()))
    placed = df if {"pos", "n"} <= set(df.columns) else positions(df, grain)
    cut = with_halo(placed, lookback, chunk)
    window = Window.partitionBy(SERIES, "_chunk").orderBy("pos")
    result = cut.withColumns(columns(window)).filter(F.col("pos") > F.col("_start"))
    extra = [c for c in ("pos", "n") if c not in df.columns]
    return result.drop("_chunk", "_start", *extra)


def blocks(
    df: DataFrame,
    lookback: int | Column,
    values: Sequence[str] = (Y,),
    carry: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per series and chunk with arrays ``pos``, ``ts`` and one per value column.

    ``carry`` names columns that are constant per series. An array holds at most
    ``chunk + lookback`` cells.
    """
    cut = with_halo(df, lookback, chunk)
    cells = F.array_sort(F.collect_list(F.struct("pos", TS, *values)))
    grouped = cut.groupBy(SERIES, "_chunk", "_start", "n", *carry).agg(cells.alias("_cells"))
    return grouped.select(
        SERIES,
        F.col("_start").alias("start"),
        "n",
        *carry,
        F.col("_cells.pos").alias("pos"),
        F.col(f"_cells.{TS}").alias(TS),
        *[F.col(f"_cells.{v}").alias(v) for v in values],
    )


def join_series(
    rows: DataFrame, per_series: DataFrame, spread: Column | None = None, how: str = "inner"
) -> DataFrame:
    """Join a table with one row per series onto the rows of many.

    Both sides carry a salt, on the small one repeated, so a series that holds most rows is dealt
    to many tasks, and what follows cannot take the join's partitioning for one by series alone.
    ``spread`` is what the salt is made of, the time if not given. A missing series is one of its own.
    """
    salt = F.pmod(F.xxhash64(F.col(TS) if spread is None else spread), F.lit(SPREAD))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>"))
    salted = per_series.withColumnRenamed(SERIES, "_of").withColumn("_part", parts)
    same = F.col(SERIES).eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_part"))
    return rows.withColumn("_salt", salt).join(salted, same, how).drop("_salt", "_part", "_of")


def sum_arrays(
    df: DataFrame,
    keys: Sequence[str],
    array: str,
    counts: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Element-wise sum of equally long arrays per key, with partial aggregation in the JVM.

    ``counts`` are summed too; ``keep`` names columns with one value per key, missing on some rows.
    """
    return (
        df.withColumn("_vector", array_to_vector(F.col(array)))
        .groupBy(*keys)
        .agg(
            Summarizer.sum(F.col("_vector")).alias("_sum"),
            *[F.sum(c).alias(c) for c in counts],
            *[F.first(c, ignorenulls=True).alias(c) for c in keep],
        )
        .withColumn(array, vector_to_array("_sum"))
        .drop("_sum")
    )
