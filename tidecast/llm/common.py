"""Text normalisation, stage tables and batch helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast import session

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The six ASCII white-space characters, as a set for btrim.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` does that on pure ASCII, and faster."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine alone
    may leave it unset; it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(session.shared_folder(spark))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a large intermediate table compactly to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition in which missing keys are equal."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a batch as UTF-8, missing ones empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def batches(rows: dict[str, list], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of at most ``size`` rows."""
    n = len(rows[schema.names[0]])
    for at in range(0, n, size):
        part = [pa.array(rows[f.name][at : at + size], f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(part, schema=schema)
