"""Given tables written to a folder of the run and read back through the readers."""

import uuid

from pyspark.sql import functions as F

from catalog.base import WEEKLY, query, rounded, table, weekly, with_sql
from tidecast.operators import clean
from tidecast.session import shared_folder
from tidecast.sources import readers, sinks


def run_folder(spark) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/read-back-{uuid.uuid4().hex}"


def _wide(spark, d):
    """Orders as a wide file: a time column, two load columns, and one that is neither."""
    return table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc_timestamp"),
        F.col("o_orderkey").alias("DE_price"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("DE_x_load_actual"),
        (F.col("o_totalprice") / 4).alias("FR_load_actual"),
    )


@query(
    "wide_csv_read",
    """SELECT 'DE_x_load_actual' AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
  CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 6) END AS load_mw FROM orders""",
)
def wide_csv_read(spark, d):
    path = sinks.write_table(_wide(spark, d), run_folder(spark), "csv")
    rows = clean.coerce_load(readers.read_wide_csv(spark, path))
    return rows.select("series_id", "ts", "load_mw")


@query(
    "wide_csv_read_all",
    """SELECT 'DE_x_load_actual' AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
  CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 6) END AS load_mw FROM orders
UNION ALL
SELECT 'FR_load_actual', CAST(o_orderdate AS TIMESTAMP), round(o_totalprice / 4, 6) FROM orders""",
)
def wide_csv_read_all(spark, d):
    path = sinks.write_table(_wide(spark, d), run_folder(spark), "csv")
    rows = clean.coerce_load(readers.read_wide_csv_all(spark, path))
    return rows.select("series_id", "ts", "load_mw")


@query("stored_series", with_sql(WEEKLY, f"SELECT series_id, ts, {rounded('y')} FROM weekly"))
def stored_series(spark, d):
    rows = weekly(spark, d).withColumnRenamed("ts", "timestamp")
    path = sinks.write_table(rows, run_folder(spark), "csv")
    return readers.read_series(spark, path, "csv").select("series_id", "ts", "y")


@query("write_unless_present", with_sql(WEEKLY, f"SELECT series_id, ts, {rounded('y')} FROM weekly"))
def write_unless_present(spark, d):
    """The second build is another table; the first one stays."""
    path = run_folder(spark)
    sinks.stored(spark, path, lambda: weekly(spark, d))
    return sinks.stored(spark, path, lambda: weekly(spark, d).limit(0))
