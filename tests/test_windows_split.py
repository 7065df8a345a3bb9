from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.operators import baselines, features, layout, sequence, split
from tidecast.schema import predictors


def ys(df, column, order="ts"):
    return [r[column] for r in df.orderBy("series_id", order).collect()]


def test_target_lag(weekly_frame):
    got = features.target_lags(weekly_frame([10, 20, 30, 40, 50]), lags=[1])
    assert ys(got, "load_lag_1") == [None, 10, 20, 30, 40]
    with pytest.raises(ValueError):
        features.target_lags(weekly_frame([1]), target="missing")


def test_rolling_mean_excludes_the_current_row(weekly_frame):
    got = features.rolling_features(weekly_frame([10, 20, 30, 40, 1000]), windows=[2])
    assert ys(got, "load_rolling_mean_2") == [None, None, 15.0, 25.0, 35.0]
    one = features.rolling_features(weekly_frame([1, 2, 3]), windows=[1])
    assert ys(one, "load_rolling_std_1") == [None, None, None]


@pytest.mark.parametrize("chunk", [7, 50, 4096])
def test_chunked_windows_equal_plain_windows(hourly_frame, chunk):
    rng = np.random.default_rng(3)
    df = hourly_frame({"a": rng.normal(size=120), "b": rng.normal(size=61), "c": [1.0]})

    def columns(w):
        return {"l9": F.lag("y", 9).over(w), "m": F.avg("y").over(w.rowsBetween(-9, -1))}

    plain = layout.over_series(df, columns, 9, "week").orderBy("series_id", "ts").collect()
    cut = layout.over_series(df, columns, 9, "hour", chunk).orderBy("series_id", "ts").collect()
    assert [(r.ts, r.l9) for r in plain] == [(r.ts, r.l9) for r in cut]
    for p, c in zip(plain, cut):
        assert (p.m is None and c.m is None) or abs(p.m - c.m) < 1e-12


def test_positions_over_time_buckets(hourly_frame):
    df = hourly_frame({"a": range(24 * 70), "b": range(5)}).orderBy(F.rand(5))
    got = layout.positions(df, "hour")
    assert got.where("pos <> y + 1").count() == 0
    assert {(r.series_id, r.n) for r in got.select("series_id", "n").distinct().collect()} == {
        ("a", 24 * 70),
        ("b", 5),
    }


@pytest.mark.parametrize("grain", ["minute", "second", "millisecond"])
def test_finer_grains_cut_finer_and_rank_alike(spark, grain):
    """The same positions as one window per series, across hours, midnight and 1970."""
    rng = np.random.default_rng(4)
    start = datetime(1969, 12, 31, 23, 50)
    offsets = np.sort(rng.choice(30 * 60_000, 1200, replace=False)).tolist()
    rows = [("hot", start + timedelta(milliseconds=o), float(i)) for i, o in enumerate(offsets)]
    rows += [("slow", start + timedelta(hours=7 * i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    got = layout.positions(df.orderBy(F.rand(1)), grain)
    assert got.count() == 1240 and got.where("pos <> y + 1").count() == 0
    assert {(r.series_id, r.n) for r in got.select("series_id", "n").distinct().collect()} == {
        ("hot", 1200),
        ("slow", 40),
    }
    bucket = layout.time_bucket(layout.BUCKET_SECONDS[grain]).alias("bucket")
    sizes = df.where("series_id = 'hot'").groupBy(bucket).count().toPandas()
    assert len(sizes) == {"minute": 2, "second": 2, "millisecond": 30}[grain]
    lagged = layout.over_series(df, lambda w: {"before": F.lag("y", 3).over(w)}, 3, grain, 100)
    assert lagged.where("y >= 3 AND (before IS NULL OR before <> y - 3)").count() == 0


def test_differences(weekly_frame):
    got = features.differences(weekly_frame(range(60))).orderBy("ts").collect()
    assert got[0].first_difference is None and got[1].first_difference == 1
    assert got[51].seasonal_difference is None and got[52].seasonal_difference == 52
    assert got[52].first_seasonal_difference is None and got[53].first_seasonal_difference == 0


def test_feature_table(spark, weekly_frame):
    df = weekly_frame(range(120)).selectExpr(
        "*",
        "10.0D AS temp_mean",
        "5.0D AS temp_min",
        "15.0D AS temp_max",
        "20.0D AS heating_degree_days",
        "0.0D AS cooling_degree_days",
    )
    table = features.feature_table(df)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert table.count() == 68
    assert len(predictors(table)) == 32
    pdf = table.toPandas()
    assert not pdf.isna().any().any()


def test_no_feature_sees_its_own_or_later_values(weekly_frame):
    base = np.arange(120.0)
    changed = base.copy()
    changed[80:] += 1000
    a = features.feature_table(weekly_frame(base)).orderBy("ts").toPandas()
    b = features.feature_table(weekly_frame(changed)).orderBy("ts").toPandas()
    upto = a["ts"] <= a["ts"].min() + timedelta(weeks=80 - 52)
    names = [c for c in a.columns if c.startswith("load_")]
    pd.testing.assert_frame_equal(a.loc[upto, names], b.loc[upto, names])


def test_iso_week_53(weekly_frame):
    from datetime import datetime

    df = weekly_frame([1.0, 2.0], start=datetime(2021, 1, 3), step=timedelta(days=-1463 + 7))
    got = {r.ts.year: (r.week_of_year, r.year) for r in features.calendar(df).collect()}
    assert got[2021] == (53, 2021)


def test_lags_stay_positional_across_a_missing_week(weekly_frame):
    df = weekly_frame([1, 2, 3, 4]).where("y <> 2")
    assert ys(features.target_lags(df, lags=[1]), "load_lag_1") == [None, 1, 3]


def test_split(weekly_frame):
    marked = split.split_last(weekly_frame(range(200)), 104)
    counts = {r.role: r["count"] for r in marked.groupBy("role").count().collect()}
    assert counts == {"train": 96, "test": 104}
    assert ys(split.test_rows(marked), "step")[:2] == [1, 2]
    short = split.split_last(weekly_frame(range(104)), 104)
    assert short.where("role IS NULL").count() == 104
    with pytest.raises(Exception, match="every row would be a test row"):
        split.split_last(weekly_frame(range(104)), 104, strict=True).collect()


def test_hourly_split_and_shuffled_input(hourly_frame):
    df = hourly_frame(range(1000)).orderBy(F.rand(1))
    marked = split.split_last(df, 200, grain="hour")
    assert split.train_rows(marked).agg(F.max("y"), F.count("y")).collect()[0][:] == (799, 800)


def test_folds(weekly_frame):
    rows = layout.positions(weekly_frame(range(145)))
    folds = split.expanding_folds(rows, 4)
    sizes = {
        (r.fold, r.fold_role): r["count"]
        for r in folds.groupBy("fold", "fold_role").count().collect()
    }
    assert [sizes[i, "train"] for i in (1, 2, 3, 4)] == [29, 58, 87, 116]
    assert {sizes[i, "validation"] for i in (1, 2, 3, 4)} == {29}


def test_validation_tail(weekly_frame):
    rows = layout.positions(weekly_frame(range(20)))
    assert split.validation_tail(rows).where("part = 'validation'").count() == 3
    with pytest.raises(Exception, match="validation part is empty"):
        split.validation_tail(layout.positions(weekly_frame(range(3))), strict=True).collect()


def test_scaler_uses_training_rows_only(weekly_frame):
    marked = split.split_last(weekly_frame({"a": [0, 5, 10, 100], "b": [4, 4, 4, 6]}), 1)
    scaled = split.scale_range(marked)
    assert ys(scaled, "scaled") == [0.0, 0.5, 1.0, 10.0, 0.0, 0.0, 0.0, 2.0]
    back = scaled.withColumn("back", split.unscale(F.col("scaled")))
    assert ys(back, "back") == [0, 5, 10, 100, 4, 4, 4, 6]


def test_standardise(weekly_frame):
    df = weekly_frame([10, 20, 30, 100]).withColumn("temperature", F.col("y"))
    marked = split.split_last(df, 1)
    assert ys(split.standardise(marked, ["temperature"]), "temperature_scaled")[-1] == 8.0
    table = split.scaling_table(marked, ["temperature"]).collect()[0]
    assert (table.training_mean, table.training_standard_deviation) == (20.0, 10.0)
    flat = marked.withColumn("temperature", F.lit(1.0))
    assert split.standardise(flat, ["temperature"]).collect()[0].temperature_scaled is None
    with pytest.raises(Exception, match="is constant"):
        split.standardise(flat, ["temperature"], strict=True).collect()


def test_sequences(hourly_frame):
    got = features.sequences(hourly_frame(range(10)), 3).orderBy("ts").collect()
    assert len(got) == 7
    assert got[0].sequence == [0, 1, 2] and got[0].y == 3
    assert features.sequences(hourly_frame(range(3)), 3).count() == 0
    with pytest.raises(Exception, match="too short for a single sequence"):
        features.sequences(hourly_frame(range(3)), 3, strict=True).collect()


def test_rolling_sequences(hourly_frame):
    marked = split.split_last(hourly_frame(range(20)), 5, grain="hour")
    got = sequence.rolling_sequences(marked, 5).orderBy("ts").collect()
    assert len(got) == 5
    assert np.allclose(np.array(got[0].sequence) * 14, [10, 11, 12, 13, 14])
    assert sequence.rolling_sequences(marked, 15, strict=True).count() == 5
    with pytest.raises(Exception, match="fewer values before it"):
        sequence.rolling_sequences(marked, 16, strict=True).collect()


def test_baselines(weekly_frame):
    marked = split.split_last(weekly_frame(range(204)), 104)
    fc = baselines.baseline_forecasts(marked).orderBy("ts").toPandas()
    assert len(fc) == 104 and not fc.isna().any().any()
    assert (fc["mean"] == 49.5).all() and (fc["naive"] == 99).all()
    assert list(fc["drift"][:3]) == [100, 101, 102]
    assert list(fc["seasonal_naive"]) == list(range(48, 100)) * 2


def test_baselines_of_short_series(weekly_frame):
    marked = split.split_last(weekly_frame({"a": range(11), "b": range(60)}), 10)
    fc = {r.series_id: r for r in baselines.baseline_forecasts(marked, 52).where("step = 1").collect()}
    assert fc["a"].seasonal_naive is None and fc["a"].drift is None and fc["a"].naive == 0
    assert fc["b"].seasonal_naive is None and fc["b"].drift == 50
    with pytest.raises(Exception, match="one season"):
        baselines.baseline_forecasts(marked, 52, strict=True).collect()


def test_two_series_equal_two_single_runs(weekly_frame):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=80), rng.normal(size=75)
    both = baselines.baseline_forecasts(split.split_last(weekly_frame({"a": a, "b": b}), 10), 12)
    for name, values in (("a", a), ("b", b)):
        one = baselines.baseline_forecasts(split.split_last(weekly_frame({name: values}), 10), 12)
        left = both.where(F.col("series_id") == name).orderBy("ts").toPandas()
        right = one.orderBy("ts").toPandas()
        pd.testing.assert_frame_equal(left, right)


def test_step_alignment(spark, weekly_frame):
    marked = split.split_last(weekly_frame(range(6)), 2)
    steps = spark.createDataFrame([("s", 1, 7.0), ("s", 2, 8.0)], "series_id string, step long, f double")
    got = baselines.align_steps(marked, steps).orderBy("ts").collect()
    assert [(r.actual, r.f) for r in got] == [(4.0, 7.0), (5.0, 8.0)]


def test_one_long_series_is_dealt_to_many_tasks(spark, tmp_path):
    """After a join by series, the chunks of one stored series do not meet in one task."""
    hours = spark.range(60_000).selectExpr(
        "'s' AS series_id",
        "timestampadd(HOUR, id, TIMESTAMP_NTZ '2000-01-01 00:00:00') AS ts",
        "CAST(id % 24 AS DOUBLE) AS y",
        "id + 1 AS pos",
        "60000L AS n",
        "59000L AS n_train",
        "IF(id < 59000, 'train', 'test') AS role",
    )
    hours.write.parquet(f"{tmp_path}/hours")
    stored = spark.read.parquet(f"{tmp_path}/hours")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in keys} | {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")
    }
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        cut = layout.blocks(split.scale_range(stored), 24, ["scaled"], [], 256)
        held = cut.groupBy(F.spark_partition_id().alias("task")).count().toPandas()["count"]
        assert held.sum() == 235 and len(held) == 8 and held.max() < 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
