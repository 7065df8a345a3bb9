"""Scans, coercion, de-duplication and filters."""

from pyspark.sql import functions as F

from catalog.base import (
    MODEL,
    READINGS,
    SHIPMENTS,
    model_rows,
    orders,
    query,
    raw_events,
    readings,
    rounded,
    shipments,
    table,
    with_sql,
)
from tidecast.functions import scalar
from tidecast.operators import clean, features, resample
from tidecast.sources import readers, sinks

RAW = """raw AS (
  SELECT event_type AS series_id,
         CASE WHEN event_type = 'signup' AND value > 20 THEN 'not a time'
              ELSE CAST(ts AS VARCHAR) END AS timestamp,
         CASE WHEN value > 40 THEN 'NaN' WHEN value > 35 THEN 'n/a'
              ELSE CAST(value AS VARCHAR) END AS load_mw,
         event_id * 2 + 1 AS ingest_seq FROM events
  UNION ALL
  SELECT event_type,
         CASE WHEN event_type = 'signup' AND value > 20 THEN 'not a time'
              ELSE CAST(ts AS VARCHAR) END,
         CASE WHEN event_type = 'error' THEN '' ELSE CAST(value + 1.0 AS VARCHAR) END,
         event_id * 2 FROM events),
typed AS (
  SELECT series_id, TRY_CAST(timestamp AS TIMESTAMP) AS ts,
         NULLIF(TRY_CAST(load_mw AS DOUBLE), CAST('NaN' AS DOUBLE)) AS load_mw, ingest_seq
  FROM raw)"""


@query(
    "scan_project",
    "SELECT l_returnflag AS series_id, l_shipdate AS ts, round(l_extendedprice / 970.0, 6) AS y "
    "FROM lineitem",
)
def scan_project(spark, d):
    return shipments(spark, d)


@query(
    "json_props",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_props(spark, d):
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", parsed.getField("k").alias("k"))


@query(
    "json_explode",
    """SELECT event_type AS series_id, ts, round(value, 6) AS temperature_2m FROM events
UNION ALL
SELECT event_type, ts + INTERVAL 1 HOUR, NULL FROM events""",
)
def json_explode(spark, d):
    """Every event written as a two-hour columnar payload, then read back as rows."""
    e = table(spark, d, "events")
    later = F.col("ts") + F.expr("INTERVAL 1 HOUR")
    hourly = F.struct(
        F.array(F.col("ts").cast("string"), later.cast("string")).alias("time"),
        F.array(F.col("value").cast("string"), F.lit("n/a")).alias("temperature_2m"),
    )
    text = F.to_json(F.struct(hourly.alias("hourly")))
    parsed = e.select("event_type", F.from_json(text, readers.HOURLY_PAYLOAD).alias("p"))
    rows = readers.explode_payload(
        parsed, F.col("p.hourly.time"), F.col("p.hourly.temperature_2m"), F.col("event_type")
    )
    return rows.select(
        "series_id",
        scalar.coerce_timestamp(F.col("timestamp")).alias("ts"),
        scalar.coerce_double(F.col("temperature_2m")).alias("temperature_2m"),
    )


@query(
    "profile",
    with_sql(
        RAW,
        """SELECT series_id, count(*) AS observations, min(ts) AS start_date, max(ts) AS end_date,
       count(*) FILTER (load_mw IS NULL) AS missing FROM typed GROUP BY 1""",
    ),
)
def profile(spark, d):
    return sinks.profile(clean.coerce_load(raw_events(spark, d)), "ts", "load_mw", ("series_id",))


@query("coerce_ts", with_sql(RAW, "SELECT series_id, ingest_seq, ts FROM typed"))
def coerce_ts(spark, d):
    return clean.coerce_load(raw_events(spark, d)).select("series_id", "ingest_seq", "ts")


@query("coerce_num", with_sql(RAW, f"SELECT series_id, ingest_seq, {rounded('load_mw')} FROM typed"))
def coerce_num(spark, d):
    return clean.coerce_load(raw_events(spark, d)).select("series_id", "ingest_seq", "load_mw")


@query(
    "unit_convert",
    "SELECT o_orderpriority AS series_id, o_orderdate AS ts, round(o_totalprice / 1000.0, 6) AS y "
    "FROM orders",
)
def unit_convert(spark, d):
    return orders(spark, d)


@query(
    "drop_subset",
    with_sql(
        RAW, f"SELECT series_id, ingest_seq, ts, {rounded('load_mw')} FROM typed WHERE ts IS NOT NULL"
    ),
)
def drop_subset(spark, d):
    return clean.drop_missing(clean.coerce_load(raw_events(spark, d)), ["ts"]).select(
        "series_id", "ingest_seq", "ts", "load_mw"
    )


@query(
    "dedupe_first",
    with_sql(
        RAW,
        """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY ingest_seq) AS k
  FROM typed WHERE ts IS NOT NULL)
SELECT series_id, ts, round(load_mw / 1000.0, 6) AS y FROM ranked
WHERE k = 1 AND ts >= TIMESTAMP '2015-01-01' AND load_mw IS NOT NULL""",
    ),
)
def dedupe_first(spark, d):
    return clean.clean_load(raw_events(spark, d))


@query(
    "dedupe_after_null",
    with_sql(
        RAW,
        """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY ingest_seq) AS k
  FROM typed WHERE ts IS NOT NULL AND load_mw IS NOT NULL)
SELECT series_id, ts, round(load_mw, 6) AS temperature_2m FROM ranked WHERE k = 1""",
    ),
)
def dedupe_after_null(spark, d):
    return readers.read_temperature(raw_events(spark, d).withColumnRenamed("load_mw", "temperature_2m"))


@query(
    "start_filter",
    with_sql(SHIPMENTS, f"SELECT series_id, ts, {rounded('y')} FROM shipments "
             "WHERE ts >= TIMESTAMP '1998-01-01'"),
)
def start_filter(spark, d):
    return clean.from_start(shipments(spark, d), "1998-01-01")


@query(
    "drop_any",
    with_sql(
        MODEL,
        """, lagged AS (
  SELECT *, lag(y, 52) OVER (PARTITION BY series_id ORDER BY ts) AS load_lag_52 FROM model)
SELECT series_id, ts, """
        + rounded("y", "temp_mean", "load_lag_52")
        + " FROM lagged WHERE load_lag_52 IS NOT NULL",
    ),
)
def drop_any(spark, d):
    lagged = features.target_lags(model_rows(spark, d), lags=[52])
    return clean.drop_missing(lagged).select("series_id", "ts", "y", "temp_mean", "load_lag_52")


@query(
    "finite_only",
    with_sql(
        RAW,
        """, mixed AS (
  SELECT series_id, ingest_seq, CASE WHEN load_mw > 30 THEN CAST('inf' AS DOUBLE)
         WHEN load_mw < 2 THEN CAST('NaN' AS DOUBLE) ELSE load_mw END AS y FROM typed)
SELECT series_id, ingest_seq, round(y, 6) AS y FROM mixed WHERE y IS NOT NULL AND isfinite(y)""",
    ),
)
def finite_only(spark, d):
    v = F.col("load_mw")
    mixed = clean.coerce_load(raw_events(spark, d)).select(
        "series_id",
        "ingest_seq",
        F.when(v > 30, F.lit(float("inf"))).when(v < 2, F.lit(float("nan"))).otherwise(v).alias("y"),
    )
    return clean.finite_only(mixed)


@query(
    "clip_degree",
    with_sql(
        READINGS,
        """SELECT ts, round(temperature_2m, 6) AS temperature_2m,
       round(greatest(18.0 - temperature_2m, 0.0), 6) AS heating,
       round(greatest(temperature_2m - 18.0, 0.0), 6) AS cooling FROM readings""",
    ),
)
def clip_degree(spark, d):
    t = F.col("temperature_2m")
    return readings(spark, d).select(
        "ts",
        "temperature_2m",
        scalar.heating(t, 18.0).alias("heating"),
        scalar.cooling(t, 18.0).alias("cooling"),
    )


@query(
    "pretty_name",
    """SELECT event_id, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2))
  || ' Of The Day' AS label FROM events""",
)
def pretty_name(spark, d):
    name = F.concat("event_type", F.lit("_of_the_day"))
    return table(spark, d, "events").select("event_id", scalar.pretty_name(name).alias("label"))


@query(
    "clean_hourly_to_weekly",
    with_sql(
        RAW,
        """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY ingest_seq) AS k
  FROM typed WHERE ts IS NOT NULL),
kept AS (SELECT series_id, ts, load_mw / 970.0 AS y FROM ranked WHERE k = 1 AND load_mw IS NOT NULL)
SELECT series_id, CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 6 DAY AS ts,
       round(avg(y), 6) AS y FROM kept GROUP BY 1, 2""",
    ),
)
def clean_hourly_to_weekly(spark, d):
    return resample.weekly_mean(clean.clean_load(raw_events(spark, d), divisor=970.0))


