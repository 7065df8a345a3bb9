"""Calendar aggregation and per-column training statistics."""

from pyspark.sql import functions as F

from catalog.base import (
    HOURLY,
    HOURLY_SPLIT,
    MODEL,
    SHIPMENTS,
    SPLIT,
    WEATHER,
    WEEK,
    WEEKLY,
    events,
    hourly_split,
    model_rows,
    query,
    readings,
    rounded,
    shipments,
    split_sql,
    table,
    weekly,
    weekly_split,
    with_sql,
)
from tidecast.operators import baselines, resample, split, stats
from tidecast.schema import WEATHER_COLUMNS


@query(
    "hourly_mean",
    with_sql(HOURLY, f"SELECT series_id, ts, {rounded('y')} FROM hourly"),
)
def hourly_mean(spark, d):
    return resample.resample_mean(events(spark, d), "hour")


@query(
    "daily_mean",
    with_sql(
        SHIPMENTS,
        """SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(avg(y), 6) AS y
FROM shipments GROUP BY 1, 2""",
    ),
)
def daily_mean(spark, d):
    return resample.daily_mean(shipments(spark, d))


@query("weekly_mean", with_sql(WEEKLY, f"SELECT series_id, ts, {rounded('y')} FROM weekly"))
def weekly_mean(spark, d):
    return weekly(spark, d)


@query(
    "weekly_stats",
    with_sql(
        WEATHER,
        f"SELECT series_id, ts, {rounded('temp_mean', 'temp_min', 'temp_max')} FROM temps",
    ),
)
def weekly_stats(spark, d):
    return resample.weekly_stats(readings(spark, d))


@query(
    "degree_days",
    with_sql(
        WEATHER,
        f"SELECT series_id, ts, {rounded('heating_degree_days', 'cooling_degree_days')} FROM degrees",
    ),
)
def degree_days(spark, d):
    return resample.degree_days(readings(spark, d))


@query(
    "weekly_weather",
    with_sql(WEATHER, f"SELECT series_id, ts, {rounded(*WEATHER_COLUMNS)} FROM weather"),
)
def weekly_weather(spark, d):
    return resample.weekly_weather(readings(spark, d))


@query(
    "left_weekly",
    with_sql(WEATHER, f"SELECT series_id, ts, {rounded(*WEATHER_COLUMNS)} FROM weather"),
)
def left_weekly(spark, d):
    r = readings(spark, d)
    return resample.join_weather(resample.weekly_stats(r), resample.degree_days(r))


@query(
    "weekly_two_cols",
    f"""SELECT l_returnflag AS series_id, {WEEK.format('l_shipdate')} AS ts,
  round(avg(l_extendedprice / 970.0), 6) AS actual, round(avg(l_quantity), 6) AS lstm
FROM lineitem GROUP BY 1, 2""",
)
def weekly_two_cols(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("series_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / 970.0).alias("actual"),
        F.col("l_quantity").alias("lstm"),
    )
    return resample.weekly_mean(rows, ["actual", "lstm"])


SUMMARY = """SELECT series_id, count(y) AS count, round(avg(y), 6) AS mean,
  round(stddev_samp(y), 6) AS std, round(min(y), 6) AS min,
  round(quantile_cont(y, 0.25), 6) AS p25, round(quantile_cont(y, 0.5), 6) AS p50,
  round(quantile_cont(y, 0.75), 6) AS p75, round(max(y), 6) AS max,
  count(*) FILTER (y IS NULL) AS missing, min(ts) AS start_date, max(ts) AS end_date
FROM {0} GROUP BY 1"""


@query("summary_stats", with_sql(SHIPMENTS, SUMMARY.format("shipments")))
def summary_stats(spark, d):
    """Over the unaggregated rows: percentiles without gathering a series."""
    return stats.summary_statistics(shipments(spark, d))


@query("summary_weekly", with_sql(WEEKLY, SUMMARY.format("weekly")))
def summary_weekly(spark, d):
    return stats.summary_statistics(weekly(spark, d), bounded=True)


MODEL_SPLIT = MODEL + ", " + split_sql("model", 104)


@query(
    "train_mean_std",
    with_sql(
        MODEL_SPLIT,
        "SELECT series_id, "
        + ", ".join(
            f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std"
            for c in WEATHER_COLUMNS
        )
        + " FROM split WHERE role = 'train' GROUP BY 1",
    ),
)
def train_mean_std(spark, d):
    return split.column_scales(split.split_last(model_rows(spark, d), 104), WEATHER_COLUMNS)


@query(
    "train_min_max",
    with_sql(
        HOURLY_SPLIT,
        """SELECT series_id, round(min(y), 6) AS scale_min,
  round(CASE WHEN max(y) = min(y) THEN 1.0 ELSE max(y) - min(y) END, 6) AS scale_range
FROM split WHERE role = 'train' GROUP BY 1""",
    ),
)
def train_min_max(spark, d):
    return split.range_scales(hourly_split(spark, d))


@query(
    "train_constants",
    with_sql(
        SPLIT,
        """SELECT series_id, round(avg(y), 6) AS train_mean, round(arg_min(y, pos), 6) AS train_first,
  round(arg_max(y, pos), 6) AS train_last, count(*) AS train_length
FROM split WHERE role = 'train' GROUP BY 1""",
    ),
)
def train_constants(spark, d):
    return baselines.train_constants(weekly_split(spark, d))


