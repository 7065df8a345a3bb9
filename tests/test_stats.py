import numpy as np
import pytest
from published import SERIES_COLUMNS, published_table

from tidecast.functions import numeric
from tidecast.operators import features, stats

ADF_COLUMNS = (
    "series",
    "adf_statistic",
    "p_value",
    "used_lags",
    "observations",
    "interpretation",
)


def test_summary_missing(weekly_frame):
    row = stats.summary_statistics(weekly_frame([50, 51, None, 49, 52]), bounded=True).collect()[0]
    assert row.missing == 1 and row["count"] == 4


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 11, 100])
def test_exact_percentiles_small(weekly_frame, n):
    values = np.random.default_rng(n).integers(0, 5, n) / 2
    row = stats.exact_percentiles(weekly_frame(values)).collect()[0]
    assert np.allclose([row.p25, row.p50, row.p75], np.percentile(values, [25, 50, 75]))


def test_exact_percentiles_with_brackets(weekly_frame):
    rng = np.random.default_rng(7)
    skewed = np.r_[np.full(1500, 2.0), rng.lognormal(size=3000)]
    table = {"a": skewed, "b": rng.normal(size=2501), "c": rng.normal(size=900)}
    got = stats.exact_percentiles(weekly_frame(table), accuracy=500)
    for row in got.collect():
        want = np.percentile(table[row.series_id], [25, 50, 75])
        assert np.allclose([row.p25, row.p50, row.p75], want, atol=1e-12)


def test_published_summary(published_weekly):
    row = stats.summary_statistics(published_weekly).collect()[0]
    want = published_table(("", "load_gw"), "count,301").set_index("Unnamed: 0")["load_gw"]
    names = dict(zip(("p25", "p50", "p75"), ("25%", "50%", "75%")))
    for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max"):
        assert abs(row[c] - float(want[names.get(c, c)])) < 1e-12
    assert str(row.start_date) == "2015-01-04 00:00:00" and str(row.end_date) == "2020-10-04 00:00:00"


def test_published_differences(published_weekly):
    got = features.differences(published_weekly).orderBy("ts").toPandas()
    want = published_table(SERIES_COLUMNS)
    for c in ("first_difference", "seasonal_difference", "first_seasonal_difference"):
        assert np.allclose(got[c], want[c], atol=1e-12, equal_nan=True)


def test_published_unit_root_tests(published_weekly):
    diffs = features.differences(published_weekly)
    got = stats.adf_of_differences(diffs).toPandas().set_index("series")
    want = published_table(ADF_COLUMNS).set_index("series")
    assert set(got.index) == set(want.index)
    for name, row in want.iterrows():
        assert abs(got.loc[name, "adf_statistic"] - row["adf_statistic"]) < 1e-9
        assert got.loc[name, "p_value"] == pytest.approx(row["p_value"], rel=1e-6)
        for c in ("used_lags", "observations", "interpretation"):
            assert got.loc[name, c] == row[c]


def test_unit_root_blocks(hourly_frame):
    rng = np.random.default_rng(42)
    df = hourly_frame({"noise": rng.normal(size=200), "walk": rng.normal(size=150).cumsum()})
    whole = stats.adf_test(df, grain="week").orderBy("series_id").toPandas()
    cut = stats.adf_test(df, grain="hour", chunk=23).orderBy("series_id").toPandas()
    assert np.allclose(whole["adf_statistic"], cut["adf_statistic"], atol=1e-8)
    assert list(whole["used_lags"]) == list(cut["used_lags"])
    assert len(whole.columns) == 7
    assert ((whole["p_value"] >= 0) & (whole["p_value"] <= 1)).all()
    assert whole["p_value"][0] < 0.01 < 0.05 < whole["p_value"][1]


def test_p_value_branches_meet():
    below, above = (numeric.unit_root_p_value(t) for t in (-1.61, -1.6099))
    assert abs(below - above) < 2e-3
    assert numeric.unit_root_p_value(3) == 1 and numeric.unit_root_p_value(-20) == 0


def naive_acf(x, lags):
    c = np.asarray(x) - np.mean(x)
    return np.array([(c[k:] * c[: len(c) - k]).sum() / (c * c).sum() for k in range(lags + 1)])


@pytest.mark.parametrize("grain", ["week", "hour"])
def test_acf_and_pacf(hourly_frame, grain):
    x = np.random.default_rng(5).normal(size=90).cumsum()
    got = stats.acf_table(hourly_frame({"a": x, "b": x[:8]}), 10, grain=grain).toPandas()
    a = got[got.series_id == "a"].sort_values("lag")
    assert np.allclose(a["acf"], naive_acf(x, 10))
    assert len(got[got.series_id == "b"]) == 8
    r = naive_acf(x, 10)
    se = [0] + [np.sqrt((1 + 2 * (r[1:k] ** 2).sum()) / 90) for k in range(1, 11)]
    assert np.allclose(a["upper_95"] - a["acf"], 1.959963984540054 * np.array(se))
    p = stats.pacf_table(hourly_frame(x), 10, grain=grain).orderBy("lag").toPandas()
    for k in range(1, 11):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(p["pacf"][k] - np.linalg.solve(system, r[1 : k + 1])[-1]) < 1e-9


def test_chi_square_tail():
    assert numeric.chi_square_tail(30.23552591618551, 20) == pytest.approx(0.06612612644461592, abs=1e-14)
    assert numeric.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert numeric.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-12)


def test_ljung_box_and_diagnostics(weekly_frame):
    x = np.random.default_rng(9).normal(size=120)
    df = weekly_frame([*x, float("nan"), float("inf")])
    row = stats.residual_diagnostics(df).collect()[0]
    r = naive_acf(x, 20)
    q = 120 * 122 * sum(r[k] ** 2 / (120 - k) for k in range(1, 21))
    assert row.ljung_box_statistic == pytest.approx(q)
    assert row.ljung_box_p_value == pytest.approx(numeric.chi_square_tail(q, 20))
    assert row.residual_mean == pytest.approx(x.mean())
    assert row.residual_standard_deviation == pytest.approx(x.std(ddof=1))
    with pytest.raises(ValueError):
        stats.ljung_box(df, 3)


@pytest.mark.parametrize("period", [4, 5])
def test_decomposition(weekly_frame, period):
    rng = np.random.default_rng(2)
    n = 41
    x = np.arange(n) * 0.3 + np.tile(rng.normal(size=period), 20)[:n] + rng.normal(size=n) * 0.1
    got = stats.decompose(weekly_frame(x), period).orderBy("ts").toPandas()
    weights = np.ones(period) if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5]
    half = len(weights) // 2
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(x, weights / period, "valid")
    first, last = half, n - half - 1
    slope, icept = np.polyfit(np.arange(first, first + period), trend[first : first + period], 1)
    trend[:first] = slope * np.arange(first) + icept
    slope, icept = np.polyfit(np.arange(last - period, last), trend[last - period : last], 1)
    trend[last + 1 :] = slope * np.arange(last + 1, n) + icept
    means = np.array([(x - trend)[i::period].mean() for i in range(period)])
    seasonal = np.tile(means - means.mean(), 20)[:n]
    assert np.allclose(got["trend"], trend)
    assert np.allclose(got["seasonal"], seasonal)
    assert np.allclose(got["residual"], x - trend - seasonal)


@pytest.mark.parametrize("chunk", [3, 10, 4096])
def test_decomposition_of_chunks(hourly_frame, chunk):
    """The same whatever the chunks, also where a chunk is shorter than the average."""
    x = np.random.default_rng(6).normal(size=90).cumsum()
    rows = hourly_frame({"a": x, "b": x[::-1] * 2, "c": x[:30], "short": x[:4]})
    want = stats.decompose(rows, 8).orderBy("series_id", "ts").toPandas()
    got = stats.decompose(rows, 8, grain="hour", chunk=chunk).orderBy("series_id", "ts").toPandas()
    assert len(got) == 90 + 90 + 30 + 4
    assert list(got["series_id"]) == list(want["series_id"])
    for c in ("observed", "trend", "seasonal", "residual"):
        assert np.allclose(got[c], want[c], equal_nan=True)


def test_unit_root_of_a_missing_series(weekly_frame):
    diffs = features.differences(weekly_frame({None: np.random.default_rng(1).normal(size=120)}), 12)
    rows = stats.adf_of_differences(diffs).collect()
    assert len(rows) == 4 and all(r.series_id is None and r.adf_statistic is not None for r in rows)
