"""Joins and unions of forecast and metric tables, and the model comparison."""

from pyspark.sql import functions as F

from catalog.base import (
    BASELINES,
    HOURLY_SPLIT,
    METRICS,
    MODEL,
    SPLIT,
    WEEK,
    WEEKLY,
    hourly_split,
    model_rows,
    query,
    rounded,
    split_sql,
    table,
    weekly_split,
    with_sql,
)
from catalog.forecasting import EVALUATED
from catalog.models import FIRST_ORDER_SQL, sar_first_order_forecast
from tidecast.operators import baselines, evaluate, features, resample, sar, split
from tidecast.schema import WEATHER_COLUMNS

ORDERS_WEEKLY = f"""orders_weekly AS (
  SELECT {WEEK.format('o_orderdate')} AS ts, avg(o_totalprice / 9700.0) AS lstm
  FROM orders GROUP BY 1)"""


def _forecasts(spark, d):
    return baselines.baseline_forecasts(weekly_split(spark, d))


def _second(spark, d):
    """A second forecast table on the same weeks: the weekly mean of all orders."""
    o = table(spark, d, "orders").select(
        F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 9700.0).alias("lstm"),
        F.lit("all").alias("series_id"),
    )
    return resample.weekly_mean(o, ["lstm"]).drop("series_id")


@query(
    "model_table",
    with_sql(MODEL, f"SELECT series_id, ts, {rounded('y', *WEATHER_COLUMNS)} FROM model"),
)
def model_table(spark, d):
    return model_rows(spark, d)


@query(
    "join_suffix",
    with_sql(
        BASELINES + ", " + ORDERS_WEEKLY,
        f"""SELECT f.series_id, ts, {rounded('lstm')}, round(f.actual, 6) AS actual_benchmark
FROM fc f JOIN orders_weekly o USING (ts)""",
    ),
)
def join_suffix(spark, d):
    right = _forecasts(spark, d).select("series_id", "ts", F.col("actual").alias("actual_benchmark"))
    return _second(spark, d).join(right, "ts").select("series_id", "ts", "lstm", "actual_benchmark")


# One covariate and no lags have a closed form too: a regression on the scaled weekly temperature.
WARM = sar.Shape(covariates=("temp_mean_scaled",))


def _warm_forecast(spark, d):
    scaled = split.standardise(split.split_last(model_rows(spark, d), 104), ["temp_mean"])
    orders = scaled.select("series_id").distinct().withColumns({c: F.lit(0) for c in sar.ORDER})
    fits = sar.refit(scaled, orders.withColumn("long_beta", F.array(*[F.lit(0.0)] * WARM_BETA)), WARM)
    return sar.forecast(scaled, fits.where("aic IS NOT NULL"), WARM, 104, "sarimax")


# The lags of the long pass, which an order without moving averages does not read.
WARM_BETA = len(WARM.covariates) + len(WARM.residual_lags(0))


@query(
    "all_forecasts",
    with_sql(
        BASELINES
        + FIRST_ORDER_SQL.format(0).removeprefix(SPLIT)
        + ", "
        + MODEL.removeprefix(WEEKLY + ", ")
        + ", "
        + split_sql("model", 104, "warm")
        + ", "
        + ORDERS_WEEKLY
        + """, ar AS (
  SELECT t.series_id, t.ts, power(phi, t.step) * s.y AS sarima
  FROM split t JOIN g ON g.series_id = t.series_id AND g.d = 0
  JOIN split s ON s.series_id = t.series_id AND s.pos = t.n_train WHERE t.role = 'test'),
scaled AS (
  SELECT series_id, ts, role, y, (temp_mean - avg(temp_mean) FILTER (role = 'train') OVER all_rows)
    / NULLIF(stddev_samp(temp_mean) FILTER (role = 'train') OVER all_rows, 0) AS x
  FROM warm WINDOW all_rows AS (PARTITION BY series_id)),
slopes AS (
  SELECT series_id, sum(x * y) / sum(x * x) AS gamma FROM scaled WHERE role = 'train' GROUP BY 1),
warmed AS (
  SELECT series_id, ts, gamma * x AS sarimax FROM scaled JOIN slopes USING (series_id)
  WHERE role = 'test')""",
        f"""SELECT f.series_id, f.ts, {rounded('actual', 'mean', 'naive', 'seasonal_naive', 'drift')},
  round(a.sarima, 6) AS sarima, round(w.sarimax, 6) AS sarimax,
  round(o.lstm, 6) AS lstm_weekly
FROM fc f LEFT JOIN ar a ON a.series_id = f.series_id AND a.ts = f.ts
LEFT JOIN warmed w ON w.series_id = f.series_id AND w.ts = f.ts
LEFT JOIN orders_weekly o ON o.ts = f.ts""",
    ),
)
def all_forecasts(spark, d):
    """Baselines, a fitted autoregression and a fitted model with weather, side by side.

    ``lstm_weekly`` is another table's weekly mean: the sequence model has no closed form in SQL.
    """
    f = _forecasts(spark, d)
    sarima = sar_first_order_forecast(spark, d).select("series_id", "ts", "sarima")
    sarimax = _warm_forecast(spark, d).select("series_id", "ts", "sarimax")
    series = f.select("series_id", "ts")
    lstm = series.join(_second(spark, d).withColumnRenamed("lstm", "lstm_weekly"), "ts")
    return evaluate.combine_forecasts(f.drop("step"), sarima, sarimax, lstm)


@query(
    "combine_long",
    with_sql(
        BASELINES,
        f"SELECT series_id, ts, {rounded('mean', 'naive', 'seasonal_naive', 'drift')} FROM fc",
    ),
)
def combine_long(spark, d):
    f = _forecasts(spark, d)
    tables = [
        f.select("series_id", "ts", F.lit(m).alias("model"), F.col(m).alias("forecast"))
        for m in baselines.BASELINES
    ]
    return evaluate.combine_long(tables, baselines.BASELINES)


COMPARED = """, base AS (
  SELECT series_id, rmse AS brmse, mae AS bmae FROM metrics WHERE model = 'seasonal_naive')"""


@query(
    "scalar_lookup",
    with_sql(
        METRICS + COMPARED,
        """SELECT series_id, model, round(rmse, 6) AS RMSE,
  round((brmse - rmse) / brmse * 100.0, 6) AS RMSE_improvement_percent
FROM metrics LEFT JOIN base USING (series_id)""",
    ),
)
def scalar_lookup(spark, d):
    s = weekly_split(spark, d)
    metrics = evaluate.evaluate(baselines.baseline_forecasts(s), s)
    return evaluate.compare_models(metrics).select(
        "series_id", "model", "RMSE", "RMSE_improvement_percent"
    )


@query(
    "union_tagged",
    with_sql(
        METRICS,
        """SELECT series_id, model, round(rmse, 6) AS RMSE, 'non_seasonal_search' AS search_stage
FROM metrics WHERE model IN ('mean', 'naive', 'drift')
UNION ALL
SELECT series_id, model, round(rmse, 6), 'seasonal_refinement' FROM metrics
WHERE model = 'seasonal_naive'""",
    ),
)
def union_tagged(spark, d):
    metrics = evaluate.error_metrics(_forecasts(spark, d)).select("series_id", "model", "RMSE")
    one = metrics.where("model <> 'seasonal_naive'").withColumn(
        "search_stage", F.lit("non_seasonal_search")
    )
    two = metrics.where("model = 'seasonal_naive'").withColumn(
        "search_stage", F.lit("seasonal_refinement")
    )
    return evaluate.union_tables(one, two)


@query(
    "union_missing_cols",
    with_sql(
        METRICS,
        """SELECT series_id, model, round(mae, 6) AS MAE, CAST(NULL AS DOUBLE) AS Bias FROM metrics
UNION ALL SELECT series_id, model, NULL, round(bias, 6) FROM metrics""",
    ),
)
def union_missing_cols(spark, d):
    metrics = evaluate.error_metrics(_forecasts(spark, d))
    return evaluate.union_tables(
        metrics.select("series_id", "model", "MAE"), metrics.select("series_id", "model", "Bias")
    )


@query(
    "sort_nulls_last",
    with_sql(
        SPLIT,
        """, l AS (
  SELECT series_id, ts, y, lag(y, 52) OVER (PARTITION BY series_id ORDER BY ts) AS bic FROM split)
SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY bic NULLS LAST, y) AS rank
FROM l""",
    ),
)
def sort_nulls_last(spark, d):
    """The search's display order, on weeks whose value a season ago may be missing."""
    s = features.target_lags(weekly_split(spark, d), lags=[52])
    orders = {c: F.lit(0) for c in sar.ORDER if c != "p"}
    # The week is the candidate's first order: what it was is read back from it.
    shown = s.select(
        "series_id",
        F.datediff("ts", F.lit("1970-01-01")).alias("p"),
        F.col("load_lag_52").alias("aic"),
        F.col("y").alias("bic"),
    ).withColumns(orders)
    ranked = sar.ranked_candidates(shown)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("p"))
    return ranked.select("series_id", day.cast("timestamp_ntz").alias("ts"), "rank")


@query(
    "weekly_seq_metrics",
    with_sql(
        BASELINES + ", " + ORDERS_WEEKLY,
        """, base AS (SELECT series_id, avg(abs(actual - seasonal_naive)) AS scale FROM fc GROUP BY 1)
SELECT f.series_id, 'lstm_weekly' AS model, round(avg(abs(lstm - actual)), 6) AS MAE,
  round(sqrt(avg(power(lstm - actual, 2))), 6) AS RMSE,
  round(avg(abs(lstm - actual)) / NULLIF(max(scale), 0), 6) AS MASE,
  round(avg(lstm - actual), 6) AS Bias
FROM fc f JOIN orders_weekly USING (ts) JOIN base b ON b.series_id = f.series_id
GROUP BY f.series_id""",
    ),
)
def weekly_seq_metrics(spark, d):
    f = _forecasts(spark, d)
    weekly = f.select("series_id", "ts", "actual").join(_second(spark, d), "ts")
    return evaluate.sequence_weekly_metrics(weekly, f)


@query(
    "model_comparison",
    with_sql(
        METRICS + COMPARED,
        f"""SELECT series_id, model, {EVALUATED}, 'weekly' AS frequency,
  'operational' AS forecast_type,
  round((brmse - rmse) / brmse * 100.0, 6) AS RMSE_improvement_percent,
  round((bmae - mae) / bmae * 100.0, 6) AS MAE_improvement_percent
FROM metrics LEFT JOIN base USING (series_id)""",
    ),
)
def model_comparison(spark, d):
    s = weekly_split(spark, d)
    metrics = evaluate.evaluate(baselines.baseline_forecasts(s), s)
    return evaluate.compare_models(evaluate.tag(metrics, "weekly", "operational"))


@query(
    "hourly_to_weekly_forecast",
    with_sql(
        HOURLY_SPLIT,
        f""", fc AS (
  SELECT t.series_id, t.ts, t.y AS actual,
         (SELECT arg_max(y, pos) FROM split z WHERE z.series_id = t.series_id AND role = 'train')
           AS lstm
  FROM split t WHERE role = 'test')
SELECT series_id, {WEEK.format('ts')} AS ts, round(avg(actual), 6) AS actual,
  round(avg(lstm), 6) AS lstm FROM fc GROUP BY 1, 2""",
    ),
)
def hourly_to_weekly_forecast(spark, d):
    s = hourly_split(spark, d)
    last = baselines.train_constants(s).select("series_id", F.col("train_last").alias("lstm"))
    rows = s.where("role = 'test'").select("series_id", "ts", F.col("y").alias("actual"))
    return evaluate.weekly_forecasts(rows.join(last, "series_id"), ["actual", "lstm"])
