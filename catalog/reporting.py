"""Tables behind the charts."""

from functools import reduce

from pyspark.sql import functions as F

from catalog.base import (
    BASELINES,
    HOURLY,
    HOURLY_SPLIT,
    METRICS,
    WEEKLY,
    hourly,
    hourly_split,
    query,
    weekly,
    weekly_split,
    with_sql,
)
from catalog.comparison import COMPARED
from catalog.models import importance_table
from catalog.windows import W
from tidecast.functions import scalar
from tidecast.operators import baselines, evaluate, features, report

NONE = "CAST(NULL AS DOUBLE) AS lower_95, CAST(NULL AS DOUBLE) AS upper_95"


def _panel_sql(ctes, models, tail, head=None):
    test = "" if head is None else f" WHERE step <= {head}"
    parts = [
        f"SELECT series_id, ts, 'training' AS kind, 'Training' AS label, round(y, 6) AS value, {NONE}, "
        f"FALSE AS is_origin FROM split WHERE role = 'train' AND pos > n_train - {tail}"
    ]
    for m in ("actual", *models):
        label = m.replace("_", " ").title()
        parts.append(
            f"SELECT series_id, ts, '{m}', '{label}', round({m}, 6), NULL, NULL, step = 1 FROM fc{test}"
        )
    return with_sql(ctes, "\nUNION ALL\n".join(parts))


@query("panel", _panel_sql(BASELINES, baselines.BASELINES, 104))
def panel(spark, d):
    s = weekly_split(spark, d)
    return report.forecast_panel(s, baselines.baseline_forecasts(s))


HOURLY_FC = (
    HOURLY_SPLIT
    + """, fc AS (
  SELECT series_id, ts, step, y AS actual, before AS lstm
  FROM (SELECT *, lag(y, 1) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM split)
  WHERE role = 'test')"""
)


def _hourly_fc(s):
    moved = features.target_lags(s, lags=[1], grain="hour").where("role = 'test'")
    return moved.select(
        "series_id", "ts", "step", F.col("y").alias("actual"), F.col("load_lag_1").alias("lstm")
    )


@query("hourly_panel", _panel_sql(HOURLY_FC, ["lstm"], 72, 72))
def hourly_panel(spark, d):
    s = hourly_split(spark, d)
    return report.forecast_panel(s, _hourly_fc(s), ["lstm"], tail=72, head=72)


def _histogram_sql(ctes, source, column, bins):
    return with_sql(
        ctes,
        f""", spans AS (
  SELECT series_id, CASE WHEN min({column}) = max({column}) THEN min({column}) - 0.5
                         ELSE min({column}) END AS lo,
         CASE WHEN min({column}) = max({column}) THEN max({column}) + 0.5
              ELSE max({column}) END AS hi, avg({column}) AS mean
  FROM {source} GROUP BY 1),
binned AS (
  SELECT s.series_id, CAST(least(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT)
    AS bin, count(*) AS c
  FROM {source} s JOIN spans USING (series_id) GROUP BY 1, 2),
grid AS (SELECT *, unnest(range(0, {bins})) AS bin FROM spans)
SELECT g.series_id, g.bin, round(lo + g.bin * (hi - lo) / {bins}, 6) AS lower,
  round(lo + (g.bin + 1) * (hi - lo) / {bins}, 6) AS upper, coalesce(c, 0) AS frequency,
  round(mean, 6) AS mean
FROM grid g LEFT JOIN binned b ON b.series_id = g.series_id AND b.bin = g.bin""",
    )


@query("histogram", _histogram_sql(WEEKLY, "weekly", "y", 25))
def histogram(spark, d):
    return report.histogram(weekly(spark, d))


@query(
    "error_histogram",
    _histogram_sql(HOURLY_FC + ", err AS (SELECT series_id, lstm - actual AS e FROM fc)", "err", "e", 50),
)
def error_histogram(spark, d):
    f = _hourly_fc(hourly_split(spark, d))
    errors = f.select("series_id", (F.col("lstm") - F.col("actual")).alias("e"))
    return report.histogram(errors, "e", 50)


def _ratio_sql(parts, r: str) -> str:
    top, below = (
        reduce(lambda total, c: f"({total} * {r} + {c!r}::DOUBLE)", reversed(p[:-1]), f"{p[-1]!r}::DOUBLE")
        for p in parts
    )
    return f"{top} / {below}"


def _qq_sql(ctes: str, source: str) -> str:
    return with_sql(
        ctes,
        f""", ranked AS (
  SELECT series_id, y AS ordered, row_number() OVER (PARTITION BY series_id ORDER BY y) AS rank,
         count(*) OVER (PARTITION BY series_id) AS n FROM {source}),
medians AS (
  SELECT *, CASE WHEN rank = n THEN power(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - power(0.5, 1.0 / n)
              ELSE (rank - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM ranked),
tails AS (SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM medians),
points AS (
  SELECT *, CASE WHEN abs(q) <= 0.425
      THEN {_ratio_sql(scalar.NORMAL_CENTRE, "(0.180625 - q * q)")} * q
    ELSE sign(q) * CASE WHEN r <= 5 THEN {_ratio_sql(scalar.NORMAL_SHOULDER, "(r - 1.6)")}
      ELSE {_ratio_sql(scalar.NORMAL_TAIL, "(r - 5)")} END END AS theoretical FROM tails)
SELECT series_id, rank, round(theoretical, 6) AS theoretical, round(ordered, 6) AS ordered,
  round(regr_slope(ordered, theoretical) OVER w, 6) AS slope,
  round(regr_intercept(ordered, theoretical) OVER w, 6) AS intercept
FROM points WINDOW w AS (PARTITION BY series_id)""",
    )


@query("qq", _qq_sql(WEEKLY, "weekly"))
def qq(spark, d):
    return report.qq_table(weekly(spark, d))


@query("qq_hourly", _qq_sql(HOURLY, "hourly"))
def qq_hourly(spark, d):
    """The same ranks from counted bins, for series that no task could order."""
    return report.qq_table(hourly(spark, d), grain="hour")


@query("top_importance")
def top_importance(spark, d):
    return report.top_rows(importance_table(spark, d), "importance", 15, ["series_id", "model"])


@query(
    "topk",
    with_sql(
        WEEKLY,
        """, r AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y DESC, ts) AS k FROM weekly)
SELECT series_id, ts, round(y, 6) AS y FROM r WHERE k <= 15""",
    ),
)
def topk(spark, d):
    return report.top_rows(weekly(spark, d), "y", 15, ["series_id"])


@query(
    "improvement_order",
    with_sql(
        METRICS + COMPARED,
        """, i AS (SELECT series_id, model, (brmse - rmse) / brmse * 100.0 AS v
  FROM metrics LEFT JOIN base USING (series_id))
SELECT series_id, model, round(v, 6) AS RMSE_improvement_percent FROM i ORDER BY series_id, v, model""",
    ),
)
def improvement_order(spark, d):
    s = weekly_split(spark, d)
    compared = evaluate.compare_models(evaluate.evaluate(baselines.baseline_forecasts(s), s))
    return report.ordered_scores(compared, "RMSE_improvement_percent")


@query(
    "unpivot_panel",
    with_sql(
        WEEKLY,
        f""", f AS (
  SELECT *, y - lag(y, 1) OVER {W} AS d1, y - lag(y, 52) OVER {W} AS d52 FROM weekly)
SELECT series_id, ts, 'y' AS kind, round(y, 6) AS value FROM f
UNION ALL SELECT series_id, ts, 'first_difference', round(d1, 6) FROM f
UNION ALL SELECT series_id, ts, 'seasonal_difference', round(d52, 6) FROM f""",
    ),
)
def unpivot_panel(spark, d):
    return report.differencing_panel(features.differences(weekly(spark, d)))


@query(
    "comparison_panel",
    with_sql(
        BASELINES,
        """SELECT series_id, ts, 'actual' AS kind, round(actual, 6) AS value FROM fc
UNION ALL SELECT series_id, ts, 'seasonal_naive', round(seasonal_naive, 6) FROM fc""",
    ),
)
def comparison_panel(spark, d):
    return report.comparison_panel(baselines.baseline_forecasts(weekly_split(spark, d)))


