"""Table sinks and the write-unless-present rule of the staged jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.session import PACKAGE


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()
) -> str:
    """Write a table as Parquet or as CSV with a header."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def _file(spark: SparkSession, path: str):
    """A path and its file system, whichever Hadoop knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its success marker, on any Hadoop file system."""
    marker, system = _file(spark, path.rstrip("/") + "/_SUCCESS")
    return bool(system.exists(marker))


@cache
def code_version() -> str:
    """A digest of the package's source files."""
    found = sorted(f for f in Path(PACKAGE).rglob("*.py"))
    return hashlib.sha256(b"".join(f.read_bytes() for f in found)).hexdigest()


def table_version(df: DataFrame) -> list[str]:
    """What a table is made of: name, size and time of its files, or a digest of rows made in memory."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        at, system = _file(spark, name)
        status = system.getFileStatus(at)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    if out:
        return [*out, df.schema.simpleString()]
    rows = df.select(F.xxhash64(*df.columns).cast("decimal(20,0)").alias("h"))
    return [str(tuple(rows.agg(F.count("h"), F.sum("h")).first())), df.schema.simpleString()]


def manifest(inputs: Sequence[DataFrame], parameters: dict) -> str:
    """A digest of all that a stage's table follows from: code, parameters, and input tables."""
    parts = [code_version(), sorted((k, repr(v)) for k, v in parameters.items()), [*map(table_version, inputs)]]
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def read_manifest(spark: SparkSession, path: str) -> str | None:
    at, system = _file(spark, f"{path.rstrip('/')}/_manifest")
    if not system.exists(at):
        return None
    reader = system.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(reader)).decode()
    finally:
        reader.close()


def write_manifest(spark: SparkSession, path: str, text: str) -> None:
    at, system = _file(spark, f"{path.rstrip('/')}/_manifest")
    writer = system.create(at, True)
    try:
        writer.write(bytearray(text.encode()))
    finally:
        writer.close()


def stored(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, made_of: str | None = None
) -> DataFrame:
    """Read the table at ``path``; build and write it first when it is absent or forced.

    With ``made_of``, a ``manifest``, a table is reused only if it was made of the same; the manifest
    is written beside the table when that is complete.
    """
    fresh = not force and table_exists(spark, path)
    if fresh and made_of is not None:
        fresh = read_manifest(spark, path) == made_of
    if not fresh:
        write_table(build(), path)
        if made_of is not None:
            write_manifest(spark, path, made_of)
    return spark.read.parquet(path)


def profile(df: DataFrame, ts: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Row count, time range and number of missing values in one pass."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"),
        F.min(ts).alias("start_date"),
        F.max(ts).alias("end_date"),
        F.count_if(F.col(value).isNull()).alias("missing"),
    )
