"""Scans: wide CSV, columnar JSON and stored series tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.scalar import coerce_double, coerce_timestamp
from tidecast.operators.clean import keep_first
from tidecast.schema import (
    LOAD_COLUMNS,
    LOAD_NEEDLE,
    LOAD_PREFIX,
    SERIES,
    TIMESTAMP_COLUMN,
    TS,
    require_columns,
    resolve_column,
)

INGEST = "ingest_seq"

HOURLY_PAYLOAD = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    T.StructField("temperature_2m", T.ArrayType(T.StringType())),
                ]
            ),
        )
    ]
)


def _file_order() -> F.Column:
    """Order of a row in its input: file, offset of the split, row within the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_wide_csv(
    spark: SparkSession,
    path: str,
    timestamp_column: str = TIMESTAMP_COLUMN,
    candidates: Sequence[str] = LOAD_COLUMNS,
    prefix: str = LOAD_PREFIX,
    needle: str = LOAD_NEEDLE,
    series: str | None = None,
) -> DataFrame:
    """Two columns of a wide CSV as text: ``timestamp`` and ``load_mw``, with the file order.

    Only the header is read to choose the load column. A file of a folder whose header differs in
    names or order is an error, never read by the first file's header.
    """
    wide = spark.read.csv(path, header=True, enforceSchema=False)
    require_columns(wide, [timestamp_column])
    column = resolve_column(wide.columns, candidates, prefix, needle)
    return wide.select(
        F.lit(series or column).alias(SERIES),
        F.col(f"`{timestamp_column}`").alias("timestamp"),
        F.col(f"`{column}`").alias("load_mw"),
        _file_order().alias(INGEST),
    )


def read_wide_csv_all(
    spark: SparkSession,
    path: str,
    timestamp_column: str = TIMESTAMP_COLUMN,
    needle: str = LOAD_NEEDLE,
) -> DataFrame:
    """Every load column of a wide CSV as its own series, in one scan; headers must agree."""
    wide = spark.read.csv(path, header=True, enforceSchema=False)
    columns = [c for c in wide.columns if needle in c]
    if not columns:
        raise ValueError(f"No column contains {needle!r}")
    ordered = wide.select(
        F.col(f"`{timestamp_column}`").alias("timestamp"),
        *[F.col(f"`{c}`") for c in columns],
        _file_order().alias(INGEST),
    )
    return ordered.unpivot(["timestamp", INGEST], columns, SERIES, "load_mw")


def explode_payload(df: DataFrame, times, values, series=None, order=None) -> DataFrame:
    """Two parallel arrays to rows ``(series_id, timestamp, temperature_2m)``, both as text.

    ``order`` places the payloads; cells of one payload follow their position. Without it the
    payloads keep the order in which they are read.
    """
    placed = df.select(
        (F.lit("s") if series is None else series).alias(SERIES),
        (F.monotonically_increasing_id() if order is None else order).alias("_payload"),
        F.posexplode(F.arrays_zip(times.alias("t"), values.alias("v"))).alias("_cell", "cell"),
    )
    return placed.select(
        SERIES,
        F.col("cell.t").cast("string").alias("timestamp"),
        F.col("cell.v").cast("string").alias("temperature_2m"),
        F.struct(F.col("_payload").alias("payload"), F.col("_cell").alias("cell")).alias(INGEST),
    )


def read_columnar_json(spark: SparkSession, path: str, series: str = "s") -> DataFrame:
    """A weather payload ``hourly.time[]`` x ``hourly.temperature_2m[]`` as one row per hour."""
    inferred = spark.read.schema(HOURLY_PAYLOAD).json(path, multiLine=True)
    checked = inferred.select(
        F.when(F.col("hourly").isNull(), F.raise_error(F.lit("Payload holds no hourly data.")))
        .otherwise(F.col("hourly"))
        .alias("hourly"),
        _file_order().alias("order"),
    )
    return explode_payload(
        checked,
        F.col("hourly.time"),
        F.col("hourly.temperature_2m"),
        F.lit(series),
        F.col("order"),
    )


def read_series(
    spark: SparkSession, path: str, fmt: str = "parquet", series: str | None = None
) -> DataFrame:
    """A stored series table; a CSV's ``timestamp`` column is parsed as UTC, other text as numbers."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = spark.read.csv(path, header=True)
    require_columns(raw, ["timestamp"])
    keys = [F.col(SERIES) if SERIES in raw.columns else F.lit(series or "s").alias(SERIES)]
    values = [
        coerce_double(F.col(f"`{c}`")).alias(c)
        for c in raw.columns
        if c not in ("timestamp", SERIES)
    ]
    return raw.select(*keys, coerce_timestamp(F.col("timestamp")).alias(TS), *values)


def read_temperature(df: DataFrame) -> DataFrame:
    """Coerce, drop missing, then keep the first row of each hour."""
    require_columns(df, ["timestamp", "temperature_2m", INGEST])
    clean = df.select(
        F.col(SERIES) if SERIES in df.columns else F.lit("s").alias(SERIES),
        coerce_timestamp(F.col("timestamp")).alias(TS),
        coerce_double(F.col("temperature_2m")).alias("temperature_2m"),
        INGEST,
    ).na.drop(subset=[TS, "temperature_2m"])
    return keep_first(clean, ["temperature_2m"], INGEST)
