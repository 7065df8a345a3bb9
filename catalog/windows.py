"""Lags, rolling features, differences, positions, sequences, splits and folds."""

from pyspark.sql import functions as F

from catalog.base import (
    HOURLY,
    HOURLY_SPLIT,
    MODEL,
    SPLIT,
    WEEKLY,
    hourly,
    hourly_split,
    model_rows,
    query,
    rounded,
    split_sql,
    weekly,
    weekly_split,
    with_sql,
)
from tidecast.operators import features, layout, report, sequence, split
from tidecast.schema import ROLLING_WINDOWS, TARGET_LAGS, WEATHER_COLUMNS

W = "(PARTITION BY series_id ORDER BY ts)"

LAGS = ", ".join(f"lag(y, {k}) OVER {W} AS load_lag_{k}" for k in TARGET_LAGS)


def frame(k: int) -> str:
    return f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def rolling(kind: str, fn: str, windows=ROLLING_WINDOWS) -> str:
    return ", ".join(
        f"CASE WHEN count(y) OVER {frame(k)} = {k} THEN {fn}(y) OVER {frame(k)} END "
        f"AS load_rolling_{kind}_{k}"
        for k in windows
    )


LAG_NAMES = [f"load_lag_{k}" for k in TARGET_LAGS]
MEAN_NAMES = [f"load_rolling_mean_{k}" for k in ROLLING_WINDOWS]
STD_NAMES = [f"load_rolling_std_{k}" for k in ROLLING_WINDOWS]
WEATHER_LAGS = [f"{c}_lag_{k}" for c in WEATHER_COLUMNS for k in (1, 2)]
WEATHER_LAG_SQL = ", ".join(
    f"lag({c}, {k}) OVER {W} AS {c}_lag_{k}" for c in WEATHER_COLUMNS for k in (1, 2)
)

CALENDAR = """CAST(weekofyear(ts) AS BIGINT) AS week_of_year, CAST(month(ts) AS BIGINT) AS month,
  CAST(quarter(ts) AS BIGINT) AS quarter, CAST(year(ts) AS BIGINT) AS year"""
CYCLE = """sin(2 * pi() * weekofyear(ts) / 52.0) AS week_sin,
  cos(2 * pi() * weekofyear(ts) / 52.0) AS week_cos"""


@query(
    "target_lags",
    with_sql(
        WEEKLY,
        f", f AS (SELECT *, {LAGS} FROM weekly) "
        f"SELECT series_id, ts, {rounded('y', *LAG_NAMES)} FROM f",
    ),
)
def target_lags(spark, d):
    return features.target_lags(weekly(spark, d))


@query(
    "hourly_lags",
    with_sql(
        HOURLY,
        f", f AS (SELECT *, lag(y, 1) OVER {W} AS load_lag_1, lag(y, 24) OVER {W} AS load_lag_24 "
        f"FROM hourly) SELECT series_id, ts, {rounded('y', 'load_lag_1', 'load_lag_24')} FROM f",
    ),
)
def hourly_lags(spark, d):
    """Lags of hourly series over chunks with history copies."""
    return features.target_lags(hourly(spark, d), lags=[1, 24], grain="hour")


@query(
    "rolling_mean",
    with_sql(
        WEEKLY,
        f", f AS (SELECT *, {rolling('mean', 'avg')} FROM weekly) "
        f"SELECT series_id, ts, {rounded(*MEAN_NAMES)} FROM f",
    ),
)
def rolling_mean(spark, d):
    return features.rolling_features(weekly(spark, d)).select("series_id", "ts", *MEAN_NAMES)


@query(
    "rolling_std",
    with_sql(
        WEEKLY,
        f", f AS (SELECT *, {rolling('std', 'stddev_samp')} FROM weekly) "
        f"SELECT series_id, ts, {rounded(*STD_NAMES)} FROM f",
    ),
)
def rolling_std(spark, d):
    return features.rolling_features(weekly(spark, d)).select("series_id", "ts", *STD_NAMES)


@query(
    "weather_lags",
    with_sql(
        MODEL,
        f", f AS (SELECT *, {WEATHER_LAG_SQL} FROM model) "
        f"SELECT series_id, ts, {rounded(*WEATHER_LAGS)} FROM f",
    ),
)
def weather_lags(spark, d):
    return features.weather_lags(model_rows(spark, d)).select("series_id", "ts", *WEATHER_LAGS)


DIFFS = f""", f AS (
  SELECT *, y - lag(y, 1) OVER {W} AS first_difference,
         y - lag(y, 52) OVER {W} AS seasonal_difference,
         (y - lag(y, 1) OVER {W}) - (lag(y, 52) OVER {W} - lag(y, 53) OVER {W})
           AS first_seasonal_difference FROM weekly)
"""


def _difference(column):
    sql = with_sql(WEEKLY, DIFFS + f"SELECT series_id, ts, {rounded(column)} FROM f")

    def run(spark, d):
        return features.differences(weekly(spark, d)).select("series_id", "ts", column)

    return sql, run


for _name, _column in (
    ("first_diff", "first_difference"),
    ("seasonal_diff", "seasonal_difference"),
    ("first_seasonal_diff", "first_seasonal_difference"),
):
    _sql, _run = _difference(_column)
    query(_name, _sql)(_run)


@query(
    "position",
    with_sql(
        HOURLY,
        f"""SELECT series_id, ts, row_number() OVER {W} AS pos,
  count(*) OVER (PARTITION BY series_id) AS n FROM hourly""",
    ),
)
def position(spark, d):
    return layout.positions(hourly(spark, d), "hour").select("series_id", "ts", "pos", "n")


SCALED = (
    HOURLY_SPLIT
    + """, scales AS (
  SELECT series_id, min(y) AS mn,
         CASE WHEN max(y) = min(y) THEN 1.0 ELSE max(y) - min(y) END AS rg
  FROM split WHERE role = 'train' GROUP BY 1),
scaled AS (
  SELECT s.*, (y - mn) / rg AS scaled, mn, rg FROM split s LEFT JOIN scales USING (series_id))"""
)


@query(
    "sequences",
    with_sql(
        SCALED,
        f""", q AS (
  SELECT series_id, ts, pos, n_train, scaled, count(scaled) OVER {frame(24)} AS c,
         string_agg(printf('%.6f', scaled), ' ') OVER {frame(24)} AS sequence
  FROM scaled WHERE role = 'train')
SELECT series_id, ts, pos - 24 AS pos, sequence,
  round(scaled, 6) AS target,
  CASE WHEN pos - 24 > (n_train - 24) - floor((n_train - 24) * 0.15) THEN 'validation'
       ELSE 'train' END AS part
FROM q WHERE c = 24""",
    ),
)
def sequences(spark, d):
    cut = sequence.supervised_sequences(hourly_split(spark, d), 24)
    text = F.transform("sequence", lambda v: F.format_string("%.6f", v))
    return cut.withColumn("sequence", F.array_join(text, " "))


@query(
    "rolling_sequences",
    with_sql(
        SCALED,
        f""", q AS (
  SELECT series_id, ts, step, role, scaled, count(scaled) OVER {frame(24)} AS c,
         string_agg(printf('%.6f', scaled), ' ') OVER {frame(24)} AS sequence FROM scaled)
SELECT series_id, ts, step, sequence,
  round(scaled, 6) AS target
FROM q WHERE c = 24 AND role = 'test'""",
    ),
)
def rolling_sequences(spark, d):
    cut = sequence.rolling_sequences(hourly_split(spark, d), 24)
    text = F.transform("sequence", lambda v: F.format_string("%.6f", v))
    return cut.withColumn("sequence", F.array_join(text, " "))


@query(
    "calendar",
    with_sql(WEEKLY, f"SELECT series_id, ts, {CALENDAR} FROM weekly"),
)
def calendar(spark, d):
    return features.calendar(weekly(spark, d)).select(
        "series_id", "ts", "week_of_year", "month", "quarter", "year"
    )


@query(
    "cyclic",
    with_sql(
        WEEKLY,
        f", f AS (SELECT series_id, ts, {CYCLE} FROM weekly) "
        f"SELECT series_id, ts, {rounded('week_sin', 'week_cos')} FROM f",
    ),
)
def cyclic(spark, d):
    return features.calendar(weekly(spark, d)).select("series_id", "ts", "week_sin", "week_cos")


@query(
    "feature_table",
    with_sql(
        MODEL,
        f""", f AS (
  SELECT *, {LAGS}, {rolling('mean', 'avg')}, {rolling('std', 'stddev_samp')}, {WEATHER_LAG_SQL},
         {CALENDAR}, {CYCLE} FROM model)
SELECT series_id, ts, week_of_year, month, quarter, year,
  {rounded('y', *WEATHER_COLUMNS, 'week_sin', 'week_cos', *LAG_NAMES, *MEAN_NAMES, *STD_NAMES, *WEATHER_LAGS)}
FROM f WHERE load_lag_52 IS NOT NULL AND load_rolling_mean_52 IS NOT NULL""",
    ),
)
def feature_table(spark, d):
    return features.feature_table(model_rows(spark, d))


@query(
    "standardise",
    with_sql(
        MODEL + ", " + split_sql("model", 104),
        """, scales AS (
  SELECT series_id, """
        + ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in WEATHER_COLUMNS)
        + """ FROM split WHERE role = 'train' GROUP BY 1)
SELECT s.series_id, s.ts, """
        + ", ".join(
            f"round(({c} - {c}_m) / NULLIF({c}_s, 0), 6) AS {c}_scaled" for c in WEATHER_COLUMNS
        )
        + " FROM split s LEFT JOIN scales USING (series_id)",
    ),
)
def standardise(spark, d):
    marked = split.split_last(model_rows(spark, d), 104)
    scaled = split.standardise(marked, WEATHER_COLUMNS)
    return scaled.select("series_id", "ts", *[f"{c}_scaled" for c in WEATHER_COLUMNS])


@query(
    "scaling_table",
    with_sql(
        MODEL + ", " + split_sql("model", 104),
        "\nUNION ALL ".join(
            f"SELECT series_id, '{c}' AS variable, round(avg({c}), 6) AS training_mean, "
            f"round(stddev_samp({c}), 6) AS training_standard_deviation "
            "FROM split WHERE role = 'train' GROUP BY 1"
            for c in WEATHER_COLUMNS
        ),
    ),
)
def scaling_table(spark, d):
    return split.scaling_table(split.split_last(model_rows(spark, d), 104), WEATHER_COLUMNS)


@query(
    "minmax_scale",
    with_sql(SCALED, f"SELECT series_id, ts, {rounded('scaled')} FROM scaled"),
)
def minmax_scale(spark, d):
    return split.scale_range(hourly_split(spark, d)).select("series_id", "ts", "scaled")


@query(
    "minmax_inverse",
    with_sql(SCALED, "SELECT series_id, ts, round(scaled * rg + mn, 6) AS y FROM scaled"),
)
def minmax_inverse(spark, d):
    scaled = split.scale_range(hourly_split(spark, d))
    return scaled.select("series_id", "ts", split.unscale(F.col("scaled")).alias("y"))


@query(
    "split_last_n",
    with_sql(SPLIT, f"SELECT series_id, ts, pos, n, n_train, role, coalesce(step, 0) AS step, {rounded('y')} FROM split"),
)
def split_last_n(spark, d):
    return weekly_split(spark, d).na.fill({"step": 0})


@query(
    "split_hourly",
    with_sql(
        HOURLY_SPLIT,
        f"SELECT series_id, ts, pos, n, n_train, role, coalesce(step, 0) AS step, {rounded('y')} FROM split",
    ),
)
def split_hourly(spark, d):
    return hourly_split(spark, d).na.fill({"step": 0})


@query(
    "ts_folds",
    with_sql(
        SPLIT,
        """, f AS (
  SELECT series_id, ts, pos, fold, n_train // 5 AS size, n_train - (n_train // 5) * (5 - fold) AS cut
  FROM split CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS fold) WHERE role = 'train')
SELECT series_id, ts, pos, CAST(fold AS BIGINT) AS fold,
  CASE WHEN pos <= cut THEN 'train' ELSE 'validation' END AS fold_role
FROM f WHERE pos <= cut + size""",
    ),
)
def ts_folds(spark, d):
    rows = split.train_rows(weekly_split(spark, d)).withColumn("n", F.col("n_train"))
    return split.expanding_folds(rows).select("series_id", "ts", "pos", "fold", "fold_role")


@query(
    "validation_tail",
    with_sql(
        SPLIT,
        """SELECT series_id, ts, pos,
  CASE WHEN pos > n - floor(n * 0.15) THEN 'validation' ELSE 'train' END AS part FROM split""",
    ),
)
def validation_tail(spark, d):
    return split.validation_tail(weekly_split(spark, d)).select("series_id", "ts", "pos", "part")


@query(
    "best_row",
    with_sql(
        WEEKLY,
        """, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y, ts) AS k FROM weekly)
SELECT series_id, ts, round(y, 6) AS y FROM r WHERE k = 1""",
    ),
)
def best_row(spark, d):
    return features.best_row(weekly(spark, d), [F.col("y"), F.col("ts")])


@query(
    "tail_slice",
    with_sql(
        SPLIT,
        f"""SELECT series_id, ts, pos, {rounded('y')} FROM split
WHERE role = 'train' AND pos > n_train - 104""",
    ),
)
def tail_slice(spark, d):
    return report.train_tail(weekly_split(spark, d), 104).select("series_id", "ts", "pos", "y")


@query("sort_time", with_sql(WEEKLY, f"SELECT series_id, ts, {rounded('y')} FROM weekly ORDER BY 1, 2"))
def sort_time(spark, d):
    return weekly(spark, d).orderBy("series_id", "ts")
