import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidecast.operators import clean, resample
from tidecast.schema import require_columns, require_timestamp, resolve_column
from tidecast.sources import readers, sinks

RAW = "series_id string, timestamp string, load_mw string, ingest_seq long"


def test_units(spark):
    raw = spark.createDataFrame(
        [("s", "2015-01-01 00:00:00", "50000", 1), ("s", "2015-01-01 01:00:00", "52000", 2)], RAW
    )
    rows = clean.clean_load(raw).orderBy("ts").collect()
    assert [r.y for r in rows] == [50.0, 52.0]


def test_missing_first_copy_removes_the_hour(spark):
    raw = spark.createDataFrame(
        [
            ("s", "2015-01-01 00:00:00", None, 1),
            ("s", "2015-01-01 00:00:00", "50000", 2),
            ("s", "2015-01-01T02:00:00+02:00", "1000", 3),
            ("s", "2015-01-01 01:00:00Z", "NaN", 4),
            ("s", "2015-01-01 02:00:00", "7000", 6),
            ("s", "2015-01-01 02:00:00", "8000", 5),
            ("s", "not a time", "9000", 7),
            ("s", "2014-12-31 23:00:00", "9000", 8),
        ],
        RAW,
    )
    load = clean.clean_load(raw).collect()
    assert [(r.ts, r.y) for r in load] == [(datetime(2015, 1, 1, 2), 8.0)]
    warm = readers.read_temperature(raw.withColumnRenamed("load_mw", "temperature_2m"))
    got = {r.ts: r.temperature_2m for r in warm.collect()}
    # Here the missing copy is dropped first, so the valid one survives.
    assert got[datetime(2015, 1, 1)] == 50000.0
    assert datetime(2015, 1, 1, 1) not in got


def test_guards(spark):
    df = spark.createDataFrame([("s", 1.0)], "series_id string, y double")
    with pytest.raises(ValueError, match="ts"):
        require_columns(df, ["ts", "y"])
    with pytest.raises(TypeError):
        require_timestamp(df.withColumn("ts", F.lit("x")))


def test_load_column_choice():
    assert resolve_column(["a", "DE_load_actual_entsoe_transparency"]).endswith("transparency")
    assert resolve_column(["DE_x", "DE_load_actual_b", "DE_load_actual_c"]) == "DE_load_actual_b"
    with pytest.raises(ValueError, match="DE_x"):
        resolve_column(["DE_x", "load_actual"])


def test_constant_hours_to_days_and_weeks(hourly_frame):
    hourly = hourly_frame([50.0] * (24 * 14))
    daily, weekly = resample.daily_mean(hourly), resample.weekly_mean(hourly)
    assert daily.count() == 14
    assert weekly.count() >= 2
    assert {r.y for r in weekly.collect()} == {50.0}


def test_week_edges_and_empty_weeks(spark):
    rows = [
        ("s", datetime(2015, 1, 4, 23, 59, 59, 500000), 1.0),
        ("s", datetime(2015, 1, 5), 2.0),
        ("s", datetime(2015, 1, 20), 4.0),
        ("s", datetime(2015, 1, 28), None),
    ]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    got = {r.ts: r.y for r in resample.weekly_mean(df).collect()}
    assert got == {
        datetime(2015, 1, 4): 1.0,
        datetime(2015, 1, 11): 2.0,
        datetime(2015, 1, 25): 4.0,
    }


def test_labels_do_not_depend_on_the_session_zone(spark, hourly_frame):
    hourly = hourly_frame(range(24 * 14))
    want = resample.weekly_mean(hourly).orderBy("ts").collect()
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert resample.weekly_mean(hourly).orderBy("ts").collect() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_weekly_weather(hourly_frame):
    n = 24 * 14
    hourly = hourly_frame([5 + 15 * i / (n - 1) for i in range(n)]).withColumnRenamed(
        "y", "temperature_2m"
    )
    fused = resample.weekly_weather(hourly).orderBy("ts")
    parts = resample.join_weather(resample.weekly_stats(hourly), resample.degree_days(hourly))
    a, b = fused.collect(), parts.orderBy("ts").collect()
    assert len(a) == len(b) and len(a) >= 2
    for x, y in zip(a, b):
        assert x.asDict().keys() == y.asDict().keys()
        for k, v in x.asDict().items():
            assert v is not None
            assert v == y[k] or abs(v - y[k]) < 1e-9


def test_columnar_json(spark, tmp_path):
    path = tmp_path / "payload.json"
    path.write_text(
        json.dumps(
            {"hourly": {"time": ["2015-01-01T00:00", "2015-01-01T01:00"], "temperature_2m": [1.5, "x"]}}
        )
    )
    rows = readers.read_columnar_json(spark, str(path))
    got = readers.read_temperature(rows).collect()
    assert [(r.ts, r.temperature_2m) for r in got] == [(datetime(2015, 1, 1), 1.5)]
    bad = tmp_path / "bad.json"
    bad.write_text('{"daily": {}}')
    with pytest.raises(Exception, match="no hourly data"):
        readers.read_columnar_json(spark, str(bad)).collect()


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text(
        "utc_timestamp,cet,DE_load_actual_entsoe_transparency,FR_load_actual_x\n"
        "2015-01-01T00:00:00Z,a,50000,1\n2015-01-01T01:00:00Z,b,,2\n"
        "2015-01-01T00:00:00Z,c,60000,3\n"
    )
    rows = readers.read_wide_csv(spark, str(path))
    assert rows.columns == ["series_id", "timestamp", "load_mw", "ingest_seq"]
    got = clean.clean_load(rows).collect()
    assert [(r.ts, r.y) for r in got] == [(datetime(2015, 1, 1), 50.0)]
    both = clean.clean_load(readers.read_wide_csv_all(spark, str(path)))
    assert {r.series_id: r.c for r in both.groupBy("series_id").agg(F.count("*").alias("c")).collect()} == {
        "DE_load_actual_entsoe_transparency": 1,
        "FR_load_actual_x": 2,
    }


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_wide_csv(spark, str(tmp_path / "none.csv"))


def test_folder_of_csv_files_with_other_headers_is_an_error(spark, tmp_path):
    head, name = "utc_timestamp", "XX_load_actual_entsoe_transparency"
    (tmp_path / "a.csv").write_text(f"{head},{name},other\n2020-01-01T00:00:00Z,1,9\n")
    (tmp_path / "b.csv").write_text(f"{head},{name},other\n2020-01-01T01:00:00Z,2,9\n")
    read = dict(candidates=[name], timestamp_column=head)
    got = readers.read_wide_csv(spark, str(tmp_path), **read)
    assert sorted(r.load_mw for r in got.collect()) == ["1", "2"]
    (tmp_path / "c.csv").write_text(f"{head},other,{name}\n2020-01-01T02:00:00Z,9,3\n")
    for table in (
        readers.read_wide_csv(spark, str(tmp_path), **read),
        readers.read_wide_csv_all(spark, str(tmp_path), timestamp_column=head, needle="load"),
    ):
        with pytest.raises(Exception, match="(?i)header"):
            table.collect()


def test_write_unless_present(spark, weekly_frame, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return weekly_frame([1, 2])

    assert not sinks.table_exists(spark, path)
    for force in (False, False, True):
        assert sinks.stored(spark, path, build, force).count() == 2
    assert len(calls) == 2


def test_hot_timestamp_is_merged_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr(
        "'s' AS series_id", "timestamp_ntz'2015-01-01' AS ts", "CAST(id AS double) AS v", "id AS k"
    )
    kept = clean.keep_first(df, ["v"], "k")
    assert kept.collect()[0].v == 0.0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_drop_missing_and_finite(spark):
    df = spark.createDataFrame(
        [(1.0,), (float("nan"),), (None,), (float("inf"),), (float("-inf"),)], "y double"
    )
    assert clean.drop_missing(df).count() == 3
    assert [r.y for r in clean.finite_only(df).collect()] == [1.0]


def test_payload_files_keep_their_order(spark, tmp_path):
    """The same hour in two files: the first file's reading stays."""
    for name, value in (("a.json", 1.0), ("b.json", 2.0)):
        body = {"hourly": {"time": ["2020-01-01T00:00", "2020-01-01T01:00"], "temperature_2m": [value, value]}}
        (tmp_path / name).write_text(json.dumps(body))
    rows = readers.read_temperature(readers.read_columnar_json(spark, str(tmp_path)))
    assert [r.temperature_2m for r in rows.collect()] == [1.0, 1.0]


def test_weather_must_not_multiply_the_load(spark):
    load = spark.sql("SELECT 's' AS series_id, TIMESTAMP_NTZ '2020-01-05' AS ts, 1.0D AS y")
    warm = spark.sql("SELECT TIMESTAMP_NTZ '2020-01-05' AS ts, explode(array(1.0D, 2.0D)) AS t")
    assert resample.model_table(load, warm.limit(1)).count() == 1
    with pytest.raises(Exception, match="several rows"):
        resample.model_table(load, warm).collect()
