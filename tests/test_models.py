import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import models
from tidecast.functions import growing, numeric
from tidecast.operators import evaluate, exact, sar, sequence, split, trees

SHAPE = sar.Shape(season=12, max_p=2, max_q=2, long_lags=6)
GRID = dict(p=[0, 1], d=[0, 1], q=[0, 1], sp=[0, 1], sd=[0, 1], sq=[0, 1])


def seasonal_series(n, seed=0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 50)
    y = np.zeros(n + 50)
    for t in range(13, n + 50):
        y[t] = 0.5 * y[t - 1] + 0.6 * y[t - 12] - 0.3 * y[t - 13] + e[t]
    return 20 + y[50:]


def test_grid(spark):
    assert len(sar.order_grid(**GRID)) == 64
    table = sar.grid_table(spark, **GRID, season=52)
    assert table.count() == 64 and table.columns == [*sar.ORDER, "season"]
    one = sar.grid_table(spark, [1], [0], [1], [1], [1], [1], 52).collect()
    assert [tuple(r) for r in one] == [(1, 0, 1, 1, 1, 1, 52)]


def test_best_of_given_results(spark):
    rows = [("s", 1, 1, 1, 1, 1, 1, 200.0, 210.0), ("s", 2, 1, 2, 1, 1, 0, 150.0, 160.0)]
    rows.append(("s", 0, 0, 0, 0, 0, 0, None, None))
    schema = f"series_id string, {sar.ORDER_SCHEMA}, aic double, bic double"
    results = spark.createDataFrame(rows, schema)
    best = sar.best_candidates(results).collect()
    assert [(r.p, r.d, r.q, r.sp, r.sd, r.sq) for r in best] == [(2, 1, 2, 1, 1, 0)]
    ranked = sar.rank_candidates(results).collect()
    assert [r.aic for r in ranked] == [150.0, 200.0, None]
    with pytest.raises(RuntimeError):
        sar.require_success(results.where("aic IS NULL"))


def test_autoregression_equals_least_squares(weekly_frame):
    """Without moving-average terms the fit is one exact regression."""
    y = seasonal_series(160)
    marked = split.split_last(weekly_frame(y), 24)
    row = sar.search_orders(marked, [(2, 1, 0, 0, 0, 0)], SHAPE).collect()[0]
    train = y[:-24]
    w = np.r_[np.nan, np.diff(train)]
    x = np.column_stack([np.r_[np.full(k, np.nan), w[:-k]] for k in (1, 2)])
    rows = np.arange(SHAPE.first_row - 1, len(train))
    beta, ssr, *_ = np.linalg.lstsq(x[rows], w[rows], rcond=None)
    n = len(rows)
    assert np.allclose(row.estimates, beta)
    assert row.observations == n and row.sigma2 == pytest.approx(ssr[0] / n)
    aic = n * (np.log(2 * np.pi * ssr[0] / n) + 1) + 2 * 3
    assert row.aic == pytest.approx(aic)
    cov = np.linalg.inv(x[rows].T @ x[rows]) * ssr[0] / n
    assert np.allclose(row.errors, np.sqrt(np.diag(cov)))


def test_multiplicative_fit_finds_the_generating_model(weekly_frame):
    marked = split.split_last(weekly_frame(seasonal_series(700, 4) - 20), 24)
    row = sar.search_orders(marked, [(1, 0, 0, 1, 0, 0)], SHAPE).collect()[0]
    assert row.converged
    assert np.allclose(row.estimates, [0.5, 0.6], atol=0.1)


def test_blocks_do_not_change_the_search(weekly_frame):
    marked = split.split_last(weekly_frame({"a": seasonal_series(160), "b": seasonal_series(150, 1)}), 24)
    keys = ["series_id", *sar.ORDER]
    whole, cut = (
        sar.search_orders(marked, sar.order_grid(**GRID), SHAPE, chunk=c).orderBy(*keys).toPandas()
        for c in (4096, 31)
    )
    assert len(whole) == 128 and whole["aic"].notna().sum() > 100
    assert np.allclose(whole["aic"], cut["aic"], rtol=1e-6, equal_nan=True)


def test_failed_candidates_are_rows(weekly_frame):
    marked = split.split_last(weekly_frame({"short": seasonal_series(50), "flat": [3.0] * 160}), 24)
    got = sar.search_orders(marked, [(1, 0, 1, 0, 1, 1), (0, 1, 0, 0, 0, 0)], SHAPE).collect()
    assert len(got) == 4
    assert all(r.aic is None and r.error for r in got)
    best = sar.best_candidates(sar.search_orders(marked, [(0, 1, 0, 0, 0, 0)], SHAPE))
    kept = sar.forecast(marked, best, SHAPE, 24)
    assert kept.count() == 48 and kept.where("sarima IS NOT NULL").count() == 0


def test_two_stages(weekly_frame):
    marked = split.split_last(weekly_frame({"a": seasonal_series(160), "b": seasonal_series(150, 1)}), 24)
    axes = dict(p=[0, 1], d=[0, 1], q=[0, 1], sp=[1], sd=[0], sq=[1])
    got = sar.two_stage_search(marked, SHAPE, axes).toPandas()
    assert got.groupby(["series_id", "search_stage"]).size().unstack().values.tolist() == [[8, 8]] * 2
    second = got[got.search_stage == "seasonal_refinement"]
    assert second.groupby("series_id")[["p", "d", "q"]].nunique().max().max() == 1


def test_full_grid_has_155_candidates(published_weekly):
    marked = split.split_last(published_weekly, 104)
    shape = sar.Shape()
    search = sar.two_stage_search(marked, shape).cache()
    assert search.count() == 155 and search.where("aic IS NULL").count() == 0
    best = sar.best_candidates(search)
    forecast = sar.forecast(marked, best, shape, 104)
    row = evaluate.evaluate(forecast.drop("lower_95", "upper_95"), marked).collect()[0]
    # The published maximum-likelihood model reaches 3.68 on the same weeks.
    assert row.RMSE < 3.75
    assert forecast.where("lower_95 < sarima AND sarima < upper_95").count() == 104


def recursive_forecast(y, e, phi, big, steps, s=12):
    out = list(y)
    for _ in range(steps):
        out.append(phi * out[-1] + big * out[-s] - phi * big * out[-s - 1])
    return out[len(y) :]


def test_forecast_recursion(weekly_frame):
    y = seasonal_series(160) - 20
    marked = split.split_last(weekly_frame(y), 24)
    best = sar.search_orders(marked, [(1, 0, 0, 1, 0, 0)], SHAPE)
    phi, big = best.collect()[0].estimates
    got = sar.forecast(marked, best, SHAPE, 24).orderBy("step").toPandas()
    assert np.allclose(got["sarima"], recursive_forecast(y[:-24], None, phi, big, 24))
    sigma = np.sqrt(best.collect()[0].sigma2)
    assert got["upper_95"][0] - got["sarima"][0] == pytest.approx(1.959963984540054 * sigma)
    assert got["upper_95"][1] - got["sarima"][1] == pytest.approx(
        1.959963984540054 * sigma * np.sqrt(1 + phi**2)
    )


def test_covariates(weekly_frame):
    rng = np.random.default_rng(8)
    x = rng.normal(size=200)
    y = 3 * x + rng.normal(size=200) * 0.1
    df = weekly_frame(y).join(weekly_frame(x).withColumnRenamed("y", "x"), ["series_id", "ts"])
    shape = sar.Shape(season=12, max_p=1, max_q=1, long_lags=4, covariates=("x",))
    marked = split.split_last(df, 20)
    best = sar.search_orders(marked, [(0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0)], shape)
    best = sar.best_candidates(best)
    table = sar.coefficient_table(best, shape).orderBy("position").toPandas()
    assert table["parameter"][0] == "x" and table["estimate"][0] == pytest.approx(3, abs=0.05)
    assert table["p_value"][0] < 1e-6 and table["parameter"].iloc[-1] == "sigma2"
    got = sar.forecast(marked, best, shape, 20, "sarimax").orderBy("step").toPandas()
    assert np.abs(got["sarimax"] - got["actual"]).max() < 0.6


def test_residuals_match_sigma(weekly_frame):
    marked = split.split_last(weekly_frame(seasonal_series(160)), 24)
    best = sar.refit(marked, sar.search_orders(marked, [(1, 0, 1, 0, 1, 1)], SHAPE), SHAPE)
    left = sar.residuals(marked, best, SHAPE, chunk=29).toPandas()
    row = best.collect()[0]
    assert len(left) == row.observations
    assert (left["y"] ** 2).mean() == pytest.approx(row.sigma2)


def slow_residuals(y, order, theta, season):
    """The recursion row by row, from zeros before the first usable row."""
    p, d, q, sp, sd, sq = order
    for _ in range(d):
        y = np.r_[np.nan, y[1:] - y[:-1]]
    for _ in range(sd):
        y = np.r_[[np.nan] * season, y[season:] - y[:-season]]
    phi, rest = theta[:p], theta[p:]
    big, small = (rest[0] if sp else 0.0), rest[sp : sp + q]
    large = rest[sp + q] if sq else 0.0
    first = d + sd * season + p + sp * season
    e = np.zeros(len(y))
    at = lambda x, t: x[t] if t >= 0 else 0.0
    for t in range(first, len(y)):
        value = y[t]
        for i, a in enumerate(phi, 1):
            value -= a * y[t - i] - (a * big * y[t - season - i] if sp else 0.0)
        value -= big * y[t - season] if sp else 0.0
        for i, a in enumerate(small, 1):
            value -= a * at(e, t - i) + a * large * at(e, t - season - i)
        e[t] = value - large * at(e, t - season)
    return e[first:]


@pytest.mark.parametrize("order", [(1, 0, 2, 1, 0, 1), (0, 1, 1, 0, 1, 1), (2, 0, 0, 0, 0, 0)])
def test_exact_residuals(weekly_frame, order):
    """Equal to the plain recursion, whatever the chunks; a lower sum of squares than the long pass."""
    y = seasonal_series(170)
    marked = split.split_last(weekly_frame({"s": y, "t": -2 * y[::-1]}), 20)
    rough = sar.refit(marked, sar.search_orders(marked, [order], SHAPE), SHAPE)
    fits = exact.refine(marked, rough, SHAPE).orderBy("series_id").collect()
    other = exact.refine(marked, rough, SHAPE, chunk=17).orderBy("series_id").collect()
    spark = marked.sparkSession
    for chunk in (9, 64, 4096):
        left = exact.exact_residuals(marked, spark.createDataFrame(fits, exact.FIT_SCHEMA), SHAPE, chunk).toPandas()
        for fit, values in zip(fits, (y, -2 * y[::-1])):
            got = left[left.series_id == fit.series_id].sort_values("pos")["y"].to_numpy()
            assert got == pytest.approx(slow_residuals(values[:150], order, np.array(fit.estimates), 12), abs=1e-9)
            assert (got**2).mean() == pytest.approx(fit.sigma2)
    for fit, same, before, values in zip(fits, other, rough.orderBy("series_id").collect(), (y, -2 * y[::-1])):
        assert fit.converged and same.estimates == pytest.approx(fit.estimates, abs=1e-6)
        start = slow_residuals(values[:150], order, np.array(before.estimates), 12)
        assert fit.sigma2 * fit.observations <= (start**2).sum() * (1 + 1e-9)
        # No small move is any better: the least squares are reached.
        for i in range(len(fit.estimates)):
            for move in (1e-3, -1e-3):
                moved = np.array(fit.estimates) + move * (np.arange(len(fit.estimates)) == i)
                assert (slow_residuals(values[:150], order, moved, 12) ** 2).sum() >= fit.sigma2 * fit.observations * (1 - 1e-6)


def test_exact_covariates_and_forecast(weekly_frame):
    rng = np.random.default_rng(4)
    x, e = rng.normal(size=220), rng.normal(size=221) * 0.3
    y = 3 * x + e[1:] + 0.6 * e[:-1]
    df = weekly_frame({"a": y}).join(weekly_frame({"a": x}).withColumnRenamed("y", "x"), ["series_id", "ts"])
    shape = sar.Shape(season=12, max_p=1, max_q=1, long_lags=4, covariates=("x",))
    marked = split.split_last(df, 20)
    rough = sar.refit(marked, sar.search_orders(marked, [(0, 0, 1, 0, 0, 0)], shape), shape)
    fit = exact.refine(marked, rough, shape, chunk=50)
    row = fit.first()
    assert row.estimates == pytest.approx([3, 0.6], abs=0.15)
    left = exact.exact_residuals(marked, fit, shape)
    got = sar.forecast(marked, fit, shape, 20, "sarimax", shocks=left).orderBy("step").toPandas()
    last = left.orderBy(F.desc("pos")).first().y
    assert got["sarimax"][0] == pytest.approx(row.estimates[0] * x[200] + row.estimates[1] * last)
    assert got["sarimax"][5] == pytest.approx(row.estimates[0] * x[205])


def test_exact_fit_of_nothing(weekly_frame):
    marked = split.split_last(weekly_frame({"s": [1.0, 2.0, 3.0]}), 1)
    rough = sar.refit(marked, sar.search_orders(marked, [(0, 0, 1, 0, 0, 0)], SHAPE), SHAPE)
    assert exact.refine(marked, rough, SHAPE).count() == 0


def test_tree_models(spark, weekly_frame):
    df = weekly_frame(range(23)).selectExpr("*", "y AS feature_1", "2 * y AS feature_2")
    marked = split.split_last(df, 3)
    names = ["feature_1", "feature_2"]
    train = trees.assemble(split.train_rows(marked), names)
    forest = trees.forest(
        dict(n_estimators=10, max_depth=4, min_samples_leaf=1, max_features="sqrt")
    ).fit(train)
    boost = trees.boosted(
        dict(n_estimators=10, learning_rate=0.1, max_depth=2, min_samples_leaf=1)
    ).fit(train)
    fc = trees.tree_forecasts(marked, names, {"random_forest": forest, "gradient_boosting": boost})
    pdf = fc.toPandas()
    assert len(pdf) == 3 and not pdf.isna().any().any()
    table = trees.importances(spark, forest, names, "random_forest")
    assert table.agg(F.sum("importance")).collect()[0][0] == pytest.approx(1.0)


def test_tree_search(weekly_frame):
    df = weekly_frame({"a": range(40), "b": range(10, 60)}).withColumn("x", F.col("y") * 2)
    marked = split.split_last(df, 5)
    grid = dict(n_estimators=[5], max_depth=[None, 2], min_samples_leaf=[1], max_features=["sqrt"])
    model, scores = trees.search_trees(marked, ["x"], "random_forest", grid, splits=2)
    rows = scores.collect()
    assert [r.validation_rmse for r in rows] == sorted(r.validation_rmse for r in rows)
    assert {r.max_depth for r in rows} == {"None", "2"}
    assert len(trees.grid_points(trees.FOREST_GRID)) == 36
    assert len(trees.grid_points(trees.BOOST_GRID)) == 24


@pytest.mark.parametrize("chunk", [40, 4096])
def test_sequence_model(hourly_frame, chunk):
    t = np.arange(400)
    wave = 50 + 10 * np.sin(2 * np.pi * t / 24)
    marked = split.split_last(hourly_frame({"wave": wave, "short": wave[:60]}), 50, grain="hour")
    grams = sequence.sequence_grams(marked, 24, chunk=chunk)
    fits = sequence.search(grams, 24, penalties=[0.0, 10.0])
    table = sequence.search_table(fits).toPandas()
    wave_rows = table[table.series_id == "wave"]
    assert list(wave_rows["candidate"]) == [1, 2]
    assert table[table.series_id == "short"]["error"].str.contains("validation part is empty").all()
    best = sequence.best_fit(fits)
    fc = sequence.rolling_forecast(marked, best, 24, chunk=chunk)
    row = sequence.hourly_metrics(fc).where("series_id = 'wave'").collect()[0]
    assert fc.where("series_id = 'wave'").count() == 50 and row.RMSE < 0.5
    unknown = fc.where("series_id = 'short'")
    assert unknown.count() == 50 and unknown.where("lstm IS NOT NULL").count() == 0
    assert row.forecast_design == "rolling one-step-ahead"
    history = sequence.training_history(best).toPandas()
    assert list(history["epoch"]) == list(range(1, len(history) + 1)) and len(history) <= 30
    assert history["val_loss"].min() == pytest.approx(wave_rows["best_validation_loss"].iloc[0])


def test_sequence_gram_equals_stored_sequences(hourly_frame):
    y = np.random.default_rng(0).normal(size=130)
    marked = split.split_last(hourly_frame(y), 20, grain="hour")
    rows = sequence.supervised_sequences(marked, 6).orderBy("pos").toPandas()
    gram = sequence.sequence_grams(marked, 6, chunk=17).collect()[0]
    assert (gram.train_rows, gram.validation_rows) == tuple(
        (rows["part"] == p).sum() for p in ("train", "validation")
    )
    for part, flat in zip(("train", "validation"), np.split(np.array(gram.gram), 2)):
        r = rows[rows.part == part]
        x = np.column_stack([r["target"], np.ones(len(r)), np.stack(r["sequence"])])
        assert np.allclose(numeric.square(flat), x.T @ x)


def plain_inputs(values, hidden):
    """Constant, values and hidden units of one sequence, unit by unit."""
    out, below = [1.0, *values], [v - 0.5 for v in values]
    for weights, offsets in hidden.projections(len(values)):
        below = [
            math.tanh(sum(b * w for b, w in zip(below, weights[:, j])) + offsets[j])
            for j in range(weights.shape[1])
        ]
        out += below
    return out


def logistic_map(n, noise=0.02):
    """A series whose next value is a parabola of the last one: no line forecasts it."""
    rng, y = np.random.default_rng(5), [0.3]
    for _ in range(n - 1):
        y.append(float(np.clip(3.8 * y[-1] * (1 - y[-1]) + rng.normal(0, noise), 0, 1)))
    return y


@pytest.mark.parametrize("chunk", [37, 4096])
def test_hidden_layers_equal_plain_loops(hourly_frame, chunk):
    hidden = sequence.Hidden((3, 5), 2)
    marked = split.split_last(hourly_frame(logistic_map(160)), 20, grain="hour")
    gram = sequence.sequence_grams(marked, 4, chunk=chunk, hidden=hidden).collect()[0]
    rows = sequence.supervised_sequences(marked, 4).orderBy("pos").toPandas()
    for part, flat in zip(("train", "validation"), np.split(np.array(gram.gram), 2)):
        r = rows[rows.part == part]
        x = np.array([[t, *plain_inputs(q, hidden)] for t, q in zip(r["target"], r["sequence"])])
        assert np.allclose(numeric.square(flat), x.T @ x)
    # A forecast is the chosen read-out of the same inputs.
    grams = sequence.sequence_grams(marked, 4, chunk=chunk, hidden=hidden)
    fits = sequence.search(grams, 4, hidden=hidden)
    deep = fits.where("units = 3 AND layers = 2 AND dropout = 0.2 AND penalty = 0.001")
    fit = deep.collect()[0]
    own = hidden.columns(4, 3, 2)
    assert own.tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 12]
    tests = sequence.rolling_sequences(marked, 4).orderBy("ts").toPandas()
    scale = split.range_scales(marked).collect()[0]
    want = [np.array(plain_inputs(q, hidden))[own] @ np.array(fit.weights) for q in tests["sequence"]]
    got = sequence.rolling_forecast(marked, deep, 4, chunk=chunk, hidden=hidden)
    made = got.orderBy("ts").toPandas()["lstm"]
    assert np.allclose(made, np.array(want) * scale.scale_range + scale.scale_min)


def test_grams_do_not_depend_on_the_order_of_blocks(hourly_frame):
    """Neither do the models fitted to them; blocks that are summed as they come differ in the last bits."""
    hidden = sequence.Hidden((3, 5), 2)
    marked = split.split_last(hourly_frame(logistic_map(160)), 20, grain="hour")
    made = [sequence.sequence_grams(marked.repartition(n), 4, chunk=7, hidden=hidden).collect()[0] for n in (1, 9)]
    assert made[0].gram == made[1].gram
    rng = np.random.default_rng(1)
    blocks = [numeric.gram(rng.random((7, 16))) for _ in range(40)]
    cut = [numeric.exact_parts(b) for b in blocks]
    sums = {sum(cut[i] for i in rng.permutation(40)).tobytes() for _ in range(20)}
    assert len(sums) == 1 and len({sum(blocks[i] for i in rng.permutation(40)).tobytes() for _ in range(20)}) > 1
    assert np.allclose(sum(np.split(sum(cut), 2)), sum(blocks), rtol=1e-14)


def test_smaller_layers_are_the_first_units_of_larger_ones():
    small, large = sequence.Hidden((4,), 2), sequence.Hidden((4, 9), 2)
    (_, _), (second, _) = large.projections(6)
    assert not second[4:, :4].any() and second[:4, :4].all() and second[:, 4:].all()
    assert [w.shape for w, _ in small.projections(6)] == [(6, 4), (4, 4)]
    assert sequence.LINEAR.projections(6) == [] and sequence.LINEAR.columns(6, 0, 0).tolist() == list(range(7))


def test_search_prefers_a_hidden_layer_only_where_a_line_fails(hourly_frame):
    hidden = sequence.Hidden()
    t = np.arange(900)
    rng = np.random.default_rng(1)
    line = 20 + 5 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.2, 900)
    frame = hourly_frame({"line": line, "map": logistic_map(900), "short": line[:30]})
    marked = split.split_last(frame, 100, grain="hour")
    fits = sequence.search(sequence.sequence_grams(marked, 6, hidden=hidden), 6, hidden=hidden)
    table = sequence.search_table(fits).toPandas()
    assert set(table.groupby("series_id")["candidate"].count()) == {8 + 2 * 2 * 2 * 3}
    linear, deep = (
        table[(table.units > 0) == kind].groupby("series_id")["best_validation_loss"].min() for kind in (False, True)
    )
    assert deep["map"] < 0.5 * linear["map"]
    best = sequence.best_fit(fits)
    scores = {}
    for name, chosen in (("all", best), ("line", sequence.best_fit(fits.where("units = 0")))):
        fc = sequence.rolling_forecast(marked, chosen, 6, hidden=hidden)
        scores[name] = {r.series_id: r.RMSE for r in sequence.hourly_metrics(fc).collect()}
    assert scores["all"]["map"] < 0.7 * scores["line"]["map"]
    assert scores["all"]["line"] < 1.1 * scores["line"]["line"]


def test_dropout_is_the_average_over_all_ways_to_drop():
    """The ridge by odds and mean squares is the expected loss, added up over every mask."""
    rng = np.random.default_rng(2)
    x, y, drop = rng.normal(size=(40, 3)), rng.normal(size=40), 0.2
    w = rng.normal(size=3)
    expected = 0.0
    for mask in itertools.product((0, 1), repeat=3):
        chance = np.prod([1 - drop if m else drop for m in mask])
        expected += chance * np.mean((y - (x * np.array(mask) / (1 - drop)) @ w) ** 2)
    ridge = drop / (1 - drop) * np.mean(x * x, axis=0)
    assert expected == pytest.approx(np.mean((y - x @ w) ** 2) + ridge @ w**2)
    both = np.column_stack([y, np.ones(40), x])
    g = both.T @ both
    noise = np.array([0.0, *[drop / (1 - drop)] * 3])
    weights, _, _ = sequence._train(g, 40, g, 40, 0.0, (30, 30, 0.0), noise)
    design = both[:, 1:]
    solved = np.linalg.solve(design.T @ design / 40 + np.diag(noise * np.mean(design**2, axis=0)), design.T @ y / 40)
    kept, _, _ = sequence._train(g, 40, g, 40, 0.0, (30, 30, 0.0))
    assert np.allclose(kept, np.linalg.lstsq(design, y, rcond=None)[0])
    assert np.linalg.norm(solved[1:]) < np.linalg.norm(kept[1:])
    assert np.mean((y - design @ weights) ** 2) <= np.mean((y - design @ solved) ** 2) + 1e-9


def test_early_stopping_keeps_the_best_weights():
    rng = np.random.default_rng(0)
    x, v = (np.column_stack([np.ones(60), rng.normal(size=(60, 8))]) for _ in range(2))
    y, z = x[:, 1] + rng.normal(size=60), v[:, 1] + rng.normal(size=60)
    grams = [np.column_stack([t, m]).T @ np.column_stack([t, m]) for t, m in ((y, x), (z, v))]
    weights, history, best = sequence._train(grams[0], 60, grams[1], 60, 0.0, (30, 4, 1e-5))
    assert np.mean((z - v @ weights) ** 2) == pytest.approx(best)
    assert len(history) <= 30 and best == min(h[2] for h in history)


def test_refit_uses_all_rows_of_the_order(spark, weekly_frame):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=220)) + 50
    marked = split.split_last(weekly_frame(list(y)), 20)
    shape = sar.Shape(season=13)
    for order, first in (((1, 1, 0, 0, 0, 0), 2), ((2, 0, 0, 1, 0, 0), 15), ((1, 0, 1, 0, 1, 0), 14)):
        best = sar.best_candidates(sar.search_orders(marked, [order], shape))
        again = sar.refit(marked, best, shape, chunk=64).first()
        assert again.observations == 200 - first > best.first().observations
        left = sar.residuals(marked, sar.refit(marked, best, shape), shape).toPandas()
        assert len(left) == again.observations
        assert np.isclose((left["y"] ** 2).mean(), again.sigma2)
    w = np.diff(y[:200])
    phi = (w[1:] @ w[:-1]) / (w[:-1] @ w[:-1])
    best = sar.best_candidates(sar.search_orders(marked, [(1, 1, 0, 0, 0, 0)], shape))
    assert np.isclose(sar.refit(marked, best, shape).first().estimates[0], phi)
    counts = sar.success_counts(sar.search_orders(marked, [(1, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0)], shape))
    assert counts.first().candidates == 2


def tree_table(spark, series, rows=60):
    rng = np.random.default_rng(2)
    rows = [
        (name, i, float(a), float(round(b, 1)), float(f * a + b * b))
        for name, f in series.items()
        for i, (a, b) in enumerate(rng.normal(size=(rows, 2)))
    ]
    table = spark.createDataFrame(rows, "series_id string, i int, a double, b double, y double").selectExpr(
        "series_id", "timestampadd(WEEK, i, TIMESTAMP_NTZ '2020-01-05 00:00:00') AS ts", "a", "b", "y"
    )
    return split.split_last(table, 10)


SMALL_GRIDS = {
    "random_forest": {
        "n_estimators": [3, 7], "max_depth": [2, None], "min_samples_leaf": [1, 4], "max_features": ["sqrt", 1.0]
    },
    "gradient_boosting": {
        "n_estimators": [4, 9], "learning_rate": [0.1, 0.5], "max_depth": [1, 3], "min_samples_leaf": [1, 5]
    },
}


def searched(marked, splits=2, **limits):
    fits = trees.tree_fits(marked, ["a", "b"], SMALL_GRIDS, splits).cache()
    scores = trees.tree_scores(fits, SMALL_GRIDS, splits)
    forecast = trees.searched_forecasts(marked, fits, scores, SMALL_GRIDS)
    return scores, forecast, trees.searched_importances(fits, scores, ["a", "b"])


def as_rows(df, series):
    cells = lambda r: [round(v, 9) if isinstance(v, float) else str(v) for v in r]
    return sorted((cells(r) for r in df.where(F.col("series_id") == series).collect()), key=str)


def slow_tree(x, y, w, depth, leaf, looked, path):
    """A regression tree, node by node, as nested tuples (feature, cut, left, right) or a mean."""
    mean = float((w * y).sum() / w.sum())
    spread = lambda at: (w[at] * (y[at] - (w[at] * y[at]).sum() / w[at].sum()) ** 2).sum()
    every = np.arange(len(y))
    best = None
    if depth and spread(every) > 1e-9:
        for f in np.flatnonzero(growing.drawn_features(np.array([path], np.uint64), x.shape[1], looked)[0]):
            values = np.unique(x[:, f])
            for low, high in zip(values, values[1:]):
                left, right = every[x[:, f] <= low], every[x[:, f] > low]
                if min(len(left), len(right)) >= leaf:
                    rest = spread(left) + spread(right)
                    if best is None or rest < best[0] - 1e-7:
                        best = rest, f, (low + high) / 2, left, right
    if best is None or best[0] > spread(every) - 1e-7:
        return mean
    _, f, cut, left, right = best
    keys = growing.mixed(np.uint64(path) + np.array([1, 2], np.uint64))
    parts = [slow_tree(x[s], y[s], w[s], depth - 1, leaf, looked, k) for s, k in zip((left, right), keys)]
    return f, cut, *parts


def slow_answer(tree, q):
    while isinstance(tree, tuple):
        tree = tree[2] if q[tree[0]] <= tree[1] else tree[3]
    return tree


def slow_ensemble(kind, point, x, y, query):
    if kind == "random_forest":
        keys = growing.tree_keys(42, np.arange(point["n_estimators"]))
        total = np.zeros(len(query))
        for key, drawn in zip(keys, growing.bootstrap(keys, len(x))):
            own = drawn > 0
            depth, looked = point["max_depth"] or 99, trees.looked_at(point["max_features"], x.shape[1])
            tree = slow_tree(x[own], y[own], drawn[own].astype(float), depth, point["min_samples_leaf"], looked, key)
            total += [slow_answer(tree, q) for q in query]
        return total / len(keys)
    now, said = np.full(len(x), y.mean()), np.full(len(query), y.mean())
    for _ in range(point["n_estimators"]):
        tree = slow_tree(x, y - now, np.ones(len(x)), point["max_depth"], point["min_samples_leaf"], 9, 0)
        now += point["learning_rate"] * np.array([slow_answer(tree, q) for q in x])
        said += point["learning_rate"] * np.array([slow_answer(tree, q) for q in query])
    return said


def test_trees_equal_plain_python(spark):
    """Every grid point on every fold, and the forecast of the best ones, node by node."""
    marked = tree_table(spark, {"p": 2.0}, rows=40)
    scores, forecast, importance = searched(marked)
    data = marked.orderBy("pos").toPandas()
    x, y = data[["a", "b"]].to_numpy(), data["y"].to_numpy()
    got = {(r.model, r.point): r for r in scores.collect()}
    assert len(got) == 16 + 16
    for kind, grid in SMALL_GRIDS.items():
        points, errors = trees.grid_points(grid), []
        for i, point in enumerate(points):
            folds = [(10, 20), (20, 30)]
            said = [slow_ensemble(kind, point, x[:a], y[:a], x[a:b]) for a, b in folds]
            errors.append(np.mean([np.sqrt(np.mean((y[a:b] - s) ** 2)) for (a, b), s in zip(folds, said)]))
            assert got[kind, i].validation_rmse == pytest.approx(errors[-1])
        want = slow_ensemble(kind, points[int(np.argmin(errors))], x[:30], y[:30], x[30:])
        rows = forecast.orderBy("step").toPandas()
        assert rows[kind].to_numpy() == pytest.approx(want)
        assert rows["actual"].to_numpy() == pytest.approx(y[30:])
    sums = importance.groupBy("model").agg(F.sum("importance").alias("s")).collect()
    assert len(sums) == 2 and all(r.s == pytest.approx(1) for r in sums)


def test_trees_of_many_series_equal_single_runs(spark):
    marked = tree_table(spark, {"p": 2.0, "q": -3.0, "short": 1.0}, rows=60)
    marked = marked.where("series_id <> 'short' OR pos <= 2")
    together = searched(marked)
    for name in ("p", "q"):
        alone = searched(marked.where(F.col("series_id") == name))
        for a, b in zip(together, alone):
            assert as_rows(a, name) == as_rows(b, name) != []
    # A series without folds has no score, no forecast and no importance.
    assert together[1].where("series_id = 'short' AND random_forest IS NOT NULL").count() == 0
    assert searched(marked.limit(0))[0].count() == 0


def test_tree_jobs_do_not_grow_with_series(spark):
    """One shuffle of blocks whatever the number of series, and no limit on it."""
    few, many = ({f"s{i}": 1.0 for i in range(n)} for n in (2, 150))
    plans = [
        trees.tree_fits(tree_table(spark, s, rows=20), ["a", "b"], SMALL_GRIDS, 2)._jdf.queryExecution().simpleString()
        for s in (few, many)
    ]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")
    small = {"random_forest": {"n_estimators": [2], "max_depth": [2], "min_samples_leaf": [1], "max_features": [1.0]}}
    fits = trees.tree_fits(tree_table(spark, many, rows=20), ["a", "b"], small, 2)
    assert fits.select("series_id").distinct().count() == 150


def test_tree_tasks_cover_the_grids():
    tasks = trees.tree_tasks(trees.GRIDS)
    for kind, grid in trees.GRIDS.items():
        for i, point in enumerate(trees.grid_points(grid)):
            own = sorted((a, b) for k, points, a, b in tasks if k == kind and i in points)
            if kind == "random_forest":
                assert sum(b - a for a, b in own) == point["n_estimators"] and own[-1][1] == point["n_estimators"]
    # Depths and sizes share their trees: 6 families of 500 trees, and one set of chains.
    assert sum(b - a for k, _, a, b in tasks if k == "random_forest") == 6 * 500
    assert sum(k == "gradient_boosting" for k, *_ in tasks) == 1


def test_sequence_queries_read_a_week(hourly_frame):
    """The same length whatever the table: a series too short for it has its error row."""
    rng = np.random.default_rng(0)
    y = np.sin(np.arange(700) * 2 * np.pi / 168) + rng.normal(0, 0.1, 700)
    marked = split.split_last(hourly_frame({"long": y.tolist(), "short": y[:300].tolist()}), 168, grain="hour")
    fits = models._sequence_fits(marked).collect()
    hidden = sequence.Hidden()
    want = sequence.search(sequence.sequence_grams(marked, 168, hidden=hidden), 168, hidden=hidden).collect()
    assert fits == want
    got = models._rolling_forecast(marked)
    assert got.where("lstm IS NOT NULL").groupBy("series_id").count().collect() == [("long", 168)]
