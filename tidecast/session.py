"""Session settings the jobs expect."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def build_session(app: str = "tidecast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on. Cluster sizes stay with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. A machine's own folder would not reach the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("name a folder, or set spark.checkpoint.dir to one that executors share")
    return folder


def shared_folder(spark: SparkSession) -> str:
    """``checkpoint_folder``; a session on one machine alone gets a folder there where none is named."""
    master = spark.sparkContext.master
    if master.split("[")[0] == "local" and not spark.conf.get("spark.checkpoint.dir", None):
        if not hasattr(spark.sparkContext, "_tidecast_folder"):
            spark.sparkContext._tidecast_folder = tempfile.mkdtemp(prefix="tidecast-")
        return spark.sparkContext._tidecast_folder
    return checkpoint_folder(spark).rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several results read, to a folder of its own below the shared one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, like ``--py-files`` does."""
    context = spark.sparkContext
    if getattr(context, "_tidecast_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tidecast-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tidecast")
    archive = shutil.make_archive(target, "zip", os.path.dirname(PACKAGE), "tidecast")
    context.addPyFile(archive)
    context._tidecast_shipped = True
