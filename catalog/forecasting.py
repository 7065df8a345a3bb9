"""Baseline forecasts and their errors."""

from pyspark.sql import functions as F

from catalog.base import (
    BASELINES,
    FC_LONG,
    METRICS,
    SPLIT,
    query,
    rounded,
    weekly_split,
    with_sql,
)
from tidecast.operators import baselines, evaluate


def _forecasts(spark, d):
    return baselines.baseline_forecasts(weekly_split(spark, d))


def _one(model):
    sql = with_sql(
        BASELINES,
        f"SELECT series_id, ts, step, {rounded('actual')}, round({model}, 6) AS forecast FROM fc",
    )

    def run(spark, d):
        return _forecasts(spark, d).select(
            "series_id", "ts", "step", "actual", F.col(model).alias("forecast")
        )

    return sql, run


for _model in baselines.BASELINES:
    _sql, _run = _one(_model)
    query(f"fc_{_model}", _sql)(_run)


@query(
    "fc_all",
    with_sql(
        BASELINES,
        f"SELECT series_id, ts, step, {rounded('actual', *baselines.BASELINES)} FROM fc",
    ),
)
def fc_all(spark, d):
    return _forecasts(spark, d)


def _metric(name):
    bodies = {
        "mae": ("MAE", "avg(abs(forecast - actual))"),
        "rmse": ("RMSE", "sqrt(avg(power(forecast - actual, 2)))"),
        "bias": ("Bias", "avg(forecast - actual)"),
    }
    column, expression = bodies[name]
    sql = with_sql(
        FC_LONG,
        f"SELECT series_id, model, round({expression}, 6) AS {column} FROM fc_long GROUP BY 1, 2",
    )

    def run(spark, d):
        return evaluate.error_metrics(_forecasts(spark, d)).select("series_id", "model", column)

    return sql, run


for _name in ("mae", "rmse", "bias"):
    _sql, _run = _metric(_name)
    query(_name, _sql)(_run)


@query("mase", with_sql(METRICS, "SELECT series_id, model, round(mase, 6) AS MASE FROM metrics"))
def mase(spark, d):
    s = weekly_split(spark, d)
    return evaluate.evaluate(baselines.baseline_forecasts(s), s).select("series_id", "model", "MASE")


@query(
    "mase_scale",
    with_sql(METRICS, "SELECT series_id, round(mase_scale, 6) AS mase_scale FROM scale"),
)
def mase_scale(spark, d):
    return evaluate.mase_scale(weekly_split(spark, d))


EVALUATED = """round(mae, 6) AS MAE, round(rmse, 6) AS RMSE, round(mase, 6) AS MASE,
  round(bias, 6) AS Bias"""


@query(
    "evaluate_many",
    with_sql(METRICS, f"SELECT series_id, model, {EVALUATED} FROM metrics"),
)
def evaluate_many(spark, d):
    s = weekly_split(spark, d)
    return evaluate.evaluate(baselines.baseline_forecasts(s), s)


BASELINE_SQL = with_sql(
    METRICS,
    f"""SELECT series_id, model, {EVALUATED},
  row_number() OVER (PARTITION BY series_id ORDER BY rmse NULLS LAST, model) AS rank
FROM metrics""",
)


@query("baseline_metrics", BASELINE_SQL)
def baseline_metrics(spark, d):
    s = weekly_split(spark, d)
    return evaluate.rank_models(evaluate.evaluate(baselines.baseline_forecasts(s), s))


@query("rank_rmse", BASELINE_SQL)
def rank_rmse(spark, d):
    return baseline_metrics(spark, d)


@query(
    "step_align",
    with_sql(
        SPLIT,
        f"""SELECT a.series_id, a.ts, a.step, round(a.y, 6) AS actual, round(b.y, 6) AS forecast
FROM split a LEFT JOIN split b ON b.series_id = a.series_id AND b.role = 'train' AND b.pos = a.step
WHERE a.role = 'test'""",
    ),
)
def step_align(spark, d):
    """Values numbered by step (here the first training rows) put on the test timestamps."""
    s = weekly_split(spark, d)
    numbered = s.where("role = 'train'").select(
        "series_id", F.col("pos").alias("step"), F.col("y").alias("forecast")
    )
    return baselines.align_steps(s, numbered)
