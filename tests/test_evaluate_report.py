from statistics import NormalDist

import numpy as np
import pytest
from published import METRIC_COLUMNS, published_path, published_table
from pyspark.sql import functions as F

from tidecast.functions.scalar import coerce_timestamp
from tidecast.operators import baselines, evaluate, report, split

BENCHMARK = ("timestamp", "actual", *baselines.BASELINES)
LIMITS = ("lower_95", "upper_95")
OTHERS = ("sarima", "sarimax", "random_forest", "gradient_boosting", "lstm_weekly")
COMPARISON = (
    *METRIC_COLUMNS,
    "frequency",
    "forecast_type",
    "RMSE_improvement_percent",
    "MAE_improvement_percent",
)


def fc(weekly_frame, actual, forecast):
    f = weekly_frame(forecast).withColumnRenamed("y", "m")
    return weekly_frame(actual).withColumnRenamed("y", "actual").join(f, ["series_id", "ts"])


def test_perfect_and_over_forecasts(weekly_frame):
    row = evaluate.error_metrics(fc(weekly_frame, [1, 2, 3], [1, 2, 3])).collect()[0]
    assert (row.MAE, row.RMSE, row.Bias) == (0, 0, 0)
    assert evaluate.error_metrics(fc(weekly_frame, [1, 2, 3], [2, 3, 4])).collect()[0].Bias == 1
    with pytest.raises(ValueError):
        evaluate.error_metrics(weekly_frame([1]))


def test_mase(weekly_frame):
    marked = split.split_last(weekly_frame(range(123)), 3)
    perfect = split.test_rows(marked).select(
        "series_id", "ts", F.col("y").alias("actual"), F.col("y").alias("m")
    )
    assert evaluate.evaluate(perfect, marked).collect()[0].MASE == 0
    assert evaluate.mase_scale(marked).collect()[0].mase_scale == 52


@pytest.mark.parametrize("train,expected", [(52, None), (53, 52.0)])
def test_mase_needs_more_rows_than_the_season(weekly_frame, train, expected):
    marked = split.split_last(weekly_frame(range(train + 3)), 3)
    assert evaluate.mase_scale(marked).collect()[0].mase_scale == expected
    if expected is None:
        with pytest.raises(Exception, match="one season"):
            evaluate.mase_scale(marked, strict=True).collect()


def test_flat_series_has_no_scale(weekly_frame):
    marked = split.split_last(weekly_frame([5.0] * 120), 3)
    assert evaluate.mase_scale(marked).collect()[0].mase_scale is None
    with pytest.raises(Exception, match="scale by is zero"):
        evaluate.mase_scale(marked, strict=True).collect()


def test_published_benchmark_numbers(published_weekly):
    marked = split.split_last(published_weekly, 104)
    got = evaluate.rank_models(evaluate.evaluate(baselines.baseline_forecasts(marked), marked))
    got = got.orderBy("rank").toPandas()
    want = published_table(METRIC_COLUMNS, "drift")
    assert list(got["model"]) == list(want["model"])
    for c in ("MAE", "RMSE", "MASE", "Bias"):
        assert np.allclose(got[c], want[c], rtol=0, atol=1e-12)
    table = baselines.baseline_forecasts(marked).orderBy("ts").toPandas()
    expected = published_table(BENCHMARK)
    for c in ("actual", *baselines.BASELINES):
        assert np.allclose(table[c], expected[c], atol=1e-12)


def read_forecasts(spark, *columns):
    raw = spark.read.csv(published_path(("timestamp", "actual", *columns)), header=True)
    numbers = [F.col(c).cast("double").alias(c) for c in raw.columns if c != "timestamp"]
    return raw.select(
        F.lit("s").alias("series_id"), coerce_timestamp(F.col("timestamp")).alias("ts"), *numbers
    )


def test_published_comparison(spark):
    benchmark = read_forecasts(spark, *baselines.BASELINES)
    weekly = read_forecasts(spark, "lstm")
    row = evaluate.sequence_weekly_metrics(weekly, benchmark).collect()[0]
    want = published_table(METRIC_COLUMNS, "lstm_weekly").iloc[0]
    for c in ("MAE", "RMSE", "MASE", "Bias"):
        assert abs(row[c] - want[c]) < 1e-12
    combined = evaluate.combine_forecasts(
        benchmark,
        read_forecasts(spark, "sarima", *LIMITS).select("series_id", "ts", "sarima"),
        read_forecasts(spark, "sarimax", *LIMITS).select("series_id", "ts", "sarimax"),
        read_forecasts(spark, "random_forest", "gradient_boosting").drop("actual"),
        weekly.select("series_id", "ts", F.col("lstm").alias("lstm_weekly")),
    )
    got = combined.orderBy("ts").toPandas()
    expected = published_table((*BENCHMARK, *OTHERS))
    assert list(got.columns[2:]) == list(expected.columns[1:])
    assert np.allclose(got[expected.columns[1:]], expected[expected.columns[1:]], atol=1e-12)


def test_published_improvements(spark):
    want = published_table(COMPARISON)
    metrics = spark.createDataFrame(want[["model", "MAE", "RMSE", "MASE", "Bias"]]).withColumn(
        "series_id", F.lit("s")
    )
    got = evaluate.rank_models(evaluate.compare_models(metrics)).orderBy("rank").toPandas()
    assert list(got["model"]) == list(want["model"])
    for c in ("RMSE_improvement_percent", "MAE_improvement_percent"):
        assert np.allclose(got[c], want[c], atol=1e-10)
    lost = metrics.where("model <> 'seasonal_naive'")
    assert evaluate.compare_models(lost).where("RMSE_improvement_percent IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="reference model"):
        evaluate.compare_models(lost, strict=True).collect()


def test_long_and_wide_combination_agree(weekly_frame):
    marked = split.split_last(weekly_frame({"a": range(80), "b": range(5, 90)}), 10)
    wide = baselines.baseline_forecasts(marked, 12)
    tables = [
        wide.select("series_id", "ts", F.lit(m).alias("model"), F.col(m).alias("forecast"))
        for m in baselines.BASELINES
    ]
    long = evaluate.combine_long(tables, baselines.BASELINES)
    keys = ["series_id", "ts"]
    a = wide.select(*keys, *baselines.BASELINES).orderBy(*keys).collect()
    assert a == long.select(*keys, *baselines.BASELINES).orderBy(*keys).collect()


def test_union_with_missing_columns(spark):
    a = spark.createDataFrame([("rf", "sqrt")], "model string, max_features string")
    b = spark.createDataFrame([("gb", 0.1)], "model string, learning_rate double")
    rows = evaluate.union_tables(a, b).orderBy("model").collect()
    assert rows[0].max_features is None and rows[1].learning_rate is None


def test_panel(weekly_frame):
    marked = split.split_last(weekly_frame(range(300)), 104)
    panel = report.forecast_panel(marked, baselines.baseline_forecasts(marked))
    counts = {r.kind: r["count"] for r in panel.groupBy("kind").count().collect()}
    assert counts == {k: 104 for k in ("training", "actual", *baselines.BASELINES)}
    assert panel.where("is_origin").count() == 5
    assert panel.where("kind = 'seasonal_naive'").first().label == "Seasonal Naive"


@pytest.mark.parametrize("values", [[3.0] * 9, [0.0, 1.0, 2.0, 10.0, 10.0, 4.4]])
def test_histogram(weekly_frame, values):
    got = report.histogram(weekly_frame(values), bins=5).orderBy("bin").toPandas()
    counts, edges = np.histogram(values, bins=5)
    assert list(got["frequency"]) == list(counts)
    assert np.allclose(got["lower"], edges[:-1]) and np.allclose(got["upper"], edges[1:])


def test_qq(weekly_frame):
    rng = np.random.default_rng(0)
    got = report.qq_table(weekly_frame(rng.normal(3, 2, 400))).toPandas()
    assert abs(got["slope"][0] - 2) < 0.3 and abs(got["intercept"][0] - 3) < 0.3
    three = report.qq_table(weekly_frame([3, 1, 2])).orderBy("rank").toPandas()
    assert list(three["ordered"]) == [1, 2, 3]
    top = NormalDist().inv_cdf(0.5 ** (1 / 3))
    assert np.allclose(three["theoretical"], [-top, 0.0, top])


def test_qq_of_counted_bins(hourly_frame, monkeypatch):
    """Equal to the window's ranks: repeated values, far outliers, one value alone."""
    rng = np.random.default_rng(1)
    values = np.r_[rng.normal(size=200).round(1), [1e9, -1e9], [0.5] * 300]
    rows = hourly_frame({"many": values, "flat": [2.0] * 40, "one": [7.0]})
    want = report.qq_table(rows).orderBy("series_id", "rank").toPandas()
    for bins, run in ((4096, 1 << 16), (3, 7)):
        monkeypatch.setattr(report, "RUN", run)
        ranked = report.ordered_values(rows, "y", bins).orderBy("series_id", "rank").toPandas()
        assert ranked["ordered"].tolist() == want["ordered"].tolist()
        assert ranked["rank"].tolist() == want["rank"].tolist()
    got = report.qq_table(rows, grain="hour").orderBy("series_id", "rank").toPandas()
    for c in ("theoretical", "ordered", "slope", "intercept"):
        assert np.allclose(got[c], want[c], equal_nan=True)


def test_top_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "feature string, v double")
    assert [r.feature for r in report.top_rows(df, "v", 2).collect()] == ["b", "c"]
    assert report.top_rows(df, "v", 1, ["feature"]).count() == 3


def test_a_missing_forecast_is_not_scored(spark):
    rows = [("s", 1.0, 1.0, 1.0), ("s", 5.0, None, 4.0)]
    table = spark.createDataFrame(rows, "series_id string, actual double, gaps double, whole double")
    got = {r.model: r for r in evaluate.error_metrics(table, counts=True).collect()}
    assert (got["gaps"].MAE, got["gaps"].RMSE, got["gaps"].Bias) == (None, None, None)
    assert (got["gaps"].expected, got["gaps"].scored) == (2, 1)
    assert (got["whole"].MAE, got["whole"].scored) == (0.5, 2)
    ranked = evaluate.rank_models(evaluate.error_metrics(table)).collect()
    assert {r.model: r["rank"] for r in ranked} == {"whole": 1, "gaps": 2}
    with pytest.raises(Exception, match="lacks forecasts"):
        evaluate.error_metrics(table, strict=True).collect()


def test_normal_quantile(spark):
    from tidecast.functions.scalar import normal_quantile

    points = [1e-300, 1e-20, 1e-12, 1e-6, 0.01, 0.07499, 0.0751, 0.3, 0.5, 0.62, 0.925, 0.9999, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in points], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in rows.collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-13, abs=1e-15)
