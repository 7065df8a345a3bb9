import os
from types import SimpleNamespace

import numpy as np
import pytest
from compare import connect, difference
from published import TESTDATA
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidecast.operators import sar
from tidecast.plans import jobs
from tidecast.session import checkpoint_folder
from tidecast.sources import sinks

FOLDER = f"{TESTDATA}/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "model", "MAE", "RMSE", "MASE", "Bias", "rank"]
    assert df.count() == 12


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = connect(FOLDER)
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, con.sql(entry.oracle_sql()[name]).df()) == ""


@needs_data
def test_study(spark, tmp_path):
    """All stages on weekly shipments as load and orders as weather."""
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    raw = lines.groupBy("l_returnflag", "l_shipdate").agg(
        F.avg("l_extendedprice").alias("v"), F.min("l_orderkey").alias("k")
    )
    raw = raw.select(
        F.col("l_returnflag").alias("series_id"),
        F.col("l_shipdate").cast("string").alias("timestamp"),
        F.col("v").cast("string").alias("load_mw"),
        F.col("k").alias("ingest_seq"),
    )
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    warm = orders.select(
        F.lit("all").alias("series_id"),
        F.col("o_orderdate").cast("string").alias("timestamp"),
        (F.col("o_totalprice") / 9700).cast("string").alias("temperature_2m"),
        F.col("o_orderkey").alias("ingest_seq"),
    )
    study = jobs.Study(
        spark, str(tmp_path), horizon=20, season=13, hourly_horizon=60, length=14, start="1992-01-01"
    )
    tuning = dict(
        stage_one=dict(p=[0, 1], d=[0, 1], q=[0, 1], sp=[1], sd=[0], sq=[1]),
        forest_grid=dict(
            n_estimators=[5], max_depth=[4], min_samples_leaf=[2], max_features=["sqrt"]
        ),
        boost_grid=dict(n_estimators=[3], learning_rate=[0.1], max_depth=[2], min_samples_leaf=[2]),
        splits=2,
    )
    ran = jobs.run_study(study, raw, warm, jobs.STAGES, **tuning)
    assert ran[0] == "preprocess" and ran[-1] == "sequence"
    out = jobs.build_comparison(study)
    models = {r.model for r in out["comparison"].select("model").distinct().collect()}
    assert models == {
        "mean", "naive", "seasonal_naive", "drift", "sarima", "sarimax",
        "random_forest", "gradient_boosting", "lstm_weekly",
    }
    assert out["comparison"].where("model = 'seasonal_naive' AND RMSE_improvement_percent <> 0").count() == 0
    assert {"sarimax", "lstm_weekly"} <= set(out["forecasts"].columns)
    assert study.read("sar_search").groupBy("series_id").count().where("count <> 16").count() == 0
    assert study.read("adf").groupBy("series_id").count().where("count <> 4").count() == 0
    modelled = ["benchmarks", "sarima", "sarimax", "feature_models"]
    assert jobs.run_study(study, stages=modelled, **tuning) == modelled
    with pytest.raises(ValueError, match="unknown stages"):
        jobs.run_study(study, stages=["weather"])
    assert os.path.exists(study.export_csv("model_comparison"))
    summary = sar.best_summary(study.read("sar_best")).columns
    assert summary[:3] == ["series_id", "order", "seasonal_order"]


def test_stages_follow_their_inputs(spark, tmp_path, weekly_frame):
    """A changed parameter or input rebuilds the stages below it and no other."""
    rng = np.random.default_rng(0)
    path = str(tmp_path / "weekly")
    weekly_frame(rng.normal(size=120).cumsum() + 50).write.parquet(path)
    for name in ("hourly", "daily"):
        weekly_frame(rng.normal(size=60)).write.parquet(str(tmp_path / name))

    def made():
        return {t: os.stat(tmp_path / t / "_manifest").st_mtime_ns for t in os.listdir(tmp_path) if (tmp_path / t / "_manifest").exists()}

    def run(**settings):
        before = made()
        study = jobs.Study(spark, str(tmp_path), horizon=20, **settings)
        jobs.explore(study, lags=5)
        jobs.run_benchmarks(study)
        after = made()
        return {t for t in after if before.get(t) != after[t]}

    first = run(season=12)
    assert {"differences", "adf", "decomposition", "weekly_summary", "benchmark_forecasts"} <= first
    assert run(season=12) == set()
    # The season changes differences, what is tested on them, the decomposition and the baselines.
    assert run(season=13) == {t for t in first if not t.endswith("_summary")}
    sinks.write_table(weekly_frame(rng.normal(size=120) + 9), path)
    assert run(season=13) == {t for t in first if t not in ("hourly_summary", "daily_summary")}


def test_default_folder_is_the_shared_one():
    session = lambda value: SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: value))
    assert checkpoint_folder(session("/shared")) == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(session(None))


def test_missing_stage(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.run_study(jobs.Study(spark, str(tmp_path)))
