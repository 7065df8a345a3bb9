"""Registry, table loaders and the SQL fragments that mirror them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators import resample
from tidecast.operators.split import split_last
from tidecast.schema import to_long
from tidecast.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return tidy(fn(spark, folder))

        REGISTRY[name] = (run, sql)
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Make results comparable between engines: six decimals, wide integers, zone-free times."""
    out = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, T.IntegralType):
            c = c.cast("long")
        elif isinstance(t, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(field.name))
    return df.select(*out)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Load-like series: three series of shipments, five of orders. The divisors hold the prime 97, so
# that no mean ends in an exact half of the sixth decimal, where engines round differently.


def shipments(spark, folder) -> DataFrame:
    price = F.col("l_extendedprice") / 970.0
    return to_long(table(spark, folder, "lineitem"), "l_returnflag", "l_shipdate", price)


def orders(spark, folder) -> DataFrame:
    price = F.col("o_totalprice") / 1000.0
    return to_long(table(spark, folder, "orders"), "o_orderpriority", "o_orderdate", price)


def events(spark, folder) -> DataFrame:
    return to_long(table(spark, folder, "events"), "event_type", "ts", F.col("value") / 9.7)


def weekly(spark, folder) -> DataFrame:
    return resample.weekly_mean(shipments(spark, folder))


def hourly(spark, folder) -> DataFrame:
    return resample.resample_mean(events(spark, folder), "hour")


def readings(spark, folder) -> DataFrame:
    """Temperature-like readings around 18 degrees: one series, from all orders."""
    t = table(spark, folder, "orders")
    return t.select(
        F.lit("all").alias("series_id"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") / 14065.0).alias("temperature_2m"),
    )


def weather(spark, folder) -> DataFrame:
    return resample.weekly_weather(readings(spark, folder))


def model_rows(spark, folder) -> DataFrame:
    return resample.model_table(weekly(spark, folder), weather(spark, folder).drop("series_id"))


def weekly_split(spark, folder, horizon: int = 104) -> DataFrame:
    return split_last(weekly(spark, folder), horizon)


def hourly_split(spark, folder, horizon: int = 168) -> DataFrame:
    return split_last(hourly(spark, folder), horizon, grain="hour")


def raw_events(spark, folder) -> DataFrame:
    """Dirty text rows: every event twice, the first copy changed, some cells unreadable."""
    e = table(spark, folder, "events")
    kind, value = F.col("event_type"), F.col("value")
    stamp = F.when((kind == "signup") & (value > 20), "not a time").otherwise(
        F.col("ts").cast("string")
    )
    text = (
        F.when(value > 40, "NaN").when(value > 35, "n/a").otherwise(value.cast("string"))
    )
    copied = F.when(kind == "error", "").otherwise((value + 1.0).cast("string"))
    cells = F.array(
        F.struct(text.alias("load_mw"), (F.col("event_id") * 2 + 1).alias("ingest_seq")),
        F.struct(copied.alias("load_mw"), (F.col("event_id") * 2).alias("ingest_seq")),
    )
    return e.select(kind.alias("series_id"), stamp.alias("timestamp"), F.inline(cells))


SHIPMENTS = """shipments AS (
  SELECT l_returnflag AS series_id, l_shipdate AS ts, l_extendedprice / 970.0 AS y FROM lineitem)"""

EVENTS = "ev AS (SELECT event_type AS series_id, ts, value / 9.7 AS y FROM events)"

WEEK = "(CAST(date_trunc('week', {0}) AS TIMESTAMP) + INTERVAL 6 DAY)"

WEEKLY = (
    SHIPMENTS
    + f""", weekly AS (
  SELECT series_id, {WEEK.format('ts')} AS ts, avg(y) AS y FROM shipments GROUP BY 1, 2)"""
)

HOURLY = (
    EVENTS
    + """, hourly AS (
  SELECT series_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(y) AS y
  FROM ev GROUP BY 1, 2)"""
)

READINGS = """readings AS (
  SELECT 'all' AS series_id, o_orderdate AS ts, o_totalprice / 14065.0 AS temperature_2m
  FROM orders)"""

WEATHER = (
    READINGS
    + f""", temps AS (
  SELECT series_id, {WEEK.format('ts')} AS ts, avg(temperature_2m) AS temp_mean,
         min(temperature_2m) AS temp_min, max(temperature_2m) AS temp_max
  FROM readings GROUP BY 1, 2),
days AS (
  SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, avg(temperature_2m) AS t
  FROM readings GROUP BY 1, 2),
degrees AS (
  SELECT series_id, {WEEK.format('ts')} AS ts, sum(greatest(18.0 - t, 0.0)) AS heating_degree_days,
         sum(greatest(t - 18.0, 0.0)) AS cooling_degree_days
  FROM days GROUP BY 1, 2),
weather AS (
  SELECT a.series_id, a.ts, temp_mean, temp_min, temp_max, heating_degree_days, cooling_degree_days
  FROM temps a LEFT JOIN degrees b USING (series_id, ts))"""
)

MODEL = (
    WEEKLY
    + ", "
    + WEATHER
    + """, model AS (
  SELECT w.series_id, w.ts, w.y, temp_mean, temp_min, temp_max, heating_degree_days,
         cooling_degree_days
  FROM weekly w JOIN weather x ON w.ts = x.ts)"""
)


def split_sql(source: str, horizon: int, name: str = "split") -> str:
    return f"""numbered_{name} AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos,
         count(*) OVER (PARTITION BY series_id) AS n FROM {source}),
{name} AS (
  SELECT *, n - {horizon} AS n_train,
         CASE WHEN n - {horizon} <= 0 THEN NULL WHEN pos > n - {horizon} THEN 'test'
              ELSE 'train' END AS role,
         CASE WHEN pos > n - {horizon} THEN pos - (n - {horizon}) END AS step
  FROM numbered_{name})"""


SPLIT = WEEKLY + ", " + split_sql("weekly", 104)
HOURLY_SPLIT = HOURLY + ", " + split_sql("hourly", 168)

BASELINES = (
    SPLIT
    + """, consts AS (
  SELECT series_id, avg(y) AS train_mean, arg_min(y, pos) AS train_first,
         arg_max(y, pos) AS train_last, count(*) AS train_length
  FROM split WHERE role = 'train' GROUP BY 1),
fc AS (
  SELECT t.series_id, t.ts, t.step, t.y AS actual, c.train_mean AS mean, c.train_last AS naive,
         CASE WHEN c.train_length >= 52 THEN s.y END AS seasonal_naive,
         CASE WHEN c.train_length >= 2
              THEN c.train_last + (c.train_last - c.train_first) / (c.train_length - 1) * t.step
         END AS drift
  FROM split t JOIN consts c USING (series_id)
  LEFT JOIN split s ON s.series_id = t.series_id
    AND s.pos = t.n_train - 52 + (t.step - 1) % 52 + 1
  WHERE t.role = 'test')"""
)

FC_LONG = (
    BASELINES
    + """, fc_long AS (
  SELECT series_id, ts, step, actual, 'mean' AS model, mean AS forecast FROM fc
  UNION ALL SELECT series_id, ts, step, actual, 'naive', naive FROM fc
  UNION ALL SELECT series_id, ts, step, actual, 'seasonal_naive', seasonal_naive FROM fc
  UNION ALL SELECT series_id, ts, step, actual, 'drift', drift FROM fc)"""
)

METRICS = (
    FC_LONG
    + """, scale AS (
  SELECT series_id, CASE WHEN count(*) > 52 THEN avg(abs(y - before)) END AS mase_scale
  FROM (SELECT *, lag(y, 52) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM split)
  WHERE role = 'train' GROUP BY 1),
metrics AS (
  SELECT f.series_id, f.model, avg(abs(forecast - actual)) AS mae,
         sqrt(avg(power(forecast - actual, 2))) AS rmse,
         avg(abs(forecast - actual)) / CASE WHEN max(abs(mase_scale)) > 1e-8 THEN max(mase_scale) END
           AS mase,
         avg(forecast - actual) AS bias
  FROM fc_long f LEFT JOIN scale s USING (series_id) GROUP BY 1, 2)"""
)


def with_sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
