"""Seasonal autoregression, trees and the sequence forecaster."""

from pyspark.sql import functions as F

from catalog.base import (
    HOURLY_SPLIT,
    SPLIT,
    hourly_split,
    model_rows,
    query,
    weekly_split,
    with_sql,
)
from tidecast.operators import evaluate, exact, features, report, sar, sequence, split, stats, trees
from tidecast.schema import SEQUENCE_LENGTH, WEATHER_COLUMNS, predictors
from tidecast.session import kept, ship_package

SHAPE = sar.Shape()
WEATHER_SHAPE = sar.Shape(covariates=tuple(f"{c}_scaled" for c in WEATHER_COLUMNS))
GRID = dict(p=range(2), d=range(2), q=range(2), sp=range(2), sd=range(2), sq=range(2))


def _weather_split(spark, d):
    marked = split.split_last(model_rows(spark, d), 104)
    return split.standardise(marked, WEATHER_COLUMNS)


@query(
    "sar_grid",
    """SELECT a.v AS p, b.v AS d, c.v AS q, e.v AS sp, f.v AS sd, g.v AS sq,
  CAST(52 AS BIGINT) AS season, s.series_id
FROM (SELECT DISTINCT l_returnflag AS series_id FROM lineitem) s,
  range(2) a(v), range(2) b(v), range(2) c(v), range(2) e(v), range(2) f(v), range(2) g(v)""",
)
def sar_grid(spark, d):
    """Candidate orders of every series in the data."""
    series = weekly_split(spark, d).select("series_id").distinct()
    return sar.with_orders(series, **GRID)


@query("sar_search")
def sar_search(spark, d):
    search = sar.search_orders(weekly_split(spark, d), sar.order_grid(**GRID), SHAPE)
    return sar.search_display(search)


# First-order autoregressions have a closed form, so SQL can check fit, scores and forecasts.
FIRST_ORDER = [(1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0)]

FIRST_ORDER_SQL = (
    SPLIT
    + f""", w AS (
  SELECT series_id, pos, n_train, 0 AS d, y AS w FROM split WHERE role = 'train'
  UNION ALL
  SELECT series_id, pos, n_train, 1, y - lag(y, 1) OVER (PARTITION BY series_id ORDER BY pos)
  FROM split WHERE role = 'train'),
l AS (SELECT *, lag(w, 1) OVER (PARTITION BY series_id, d ORDER BY pos) AS b FROM w),
g AS (
  SELECT series_id, d, count(*) AS n, sum(w * b) / sum(b * b) AS phi,
         sum(w * w) - sum(w * b) * sum(w * b) / sum(b * b) AS ssr
  FROM l WHERE pos >= {{0}} AND w IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2)"""
)


FIRST_ORDER_COLUMNS = """SELECT series_id, CAST(d AS BIGINT) AS d, n AS observations,
  round(phi, 6) AS estimate,
  round(ssr / n, 6) AS sigma2, round(-0.5 * n * (ln(2 * pi() * ssr / n) + 1), 6) AS log_likelihood,
  round(n * (ln(2 * pi() * ssr / n) + 1) + 4, 6) AS aic,
  round(n * (ln(2 * pi() * ssr / n) + 1) + 2 * ln(n), 6) AS bic FROM g"""


def _first_order(fits):
    return fits.select(
        "series_id",
        "d",
        "observations",
        F.col("estimates")[0].alias("estimate"),
        "sigma2",
        "log_likelihood",
        "aic",
        "bic",
    )


@query(
    "sar_first_order",
    with_sql(FIRST_ORDER_SQL.format(SHAPE.first_row), FIRST_ORDER_COLUMNS),
)
def sar_first_order(spark, d):
    """Candidates are scored on the rows that all orders of the shape can use."""
    return _first_order(sar.search_orders(weekly_split(spark, d), FIRST_ORDER, SHAPE))


@query(
    "sar_refit",
    with_sql(FIRST_ORDER_SQL.format(0), FIRST_ORDER_COLUMNS + " WHERE d = 1"),
)
def sar_refit(spark, d):
    """The chosen order is fitted on every row it can use."""
    s = weekly_split(spark, d)
    best = sar.best_candidates(sar.search_orders(s, FIRST_ORDER[1:], SHAPE))
    return _first_order(sar.refit(s, best, SHAPE))


@query(
    "sar_first_order_forecast",
    with_sql(
        FIRST_ORDER_SQL.format(0),
        """, f AS (
  SELECT t.series_id, t.ts, t.step, t.y AS actual, power(phi, t.step) * s.y AS sarima,
    1.959963984540054 * sqrt(ssr / g.n * (1 - power(phi, 2 * t.step)) / (1 - phi * phi)) AS half
  FROM split t JOIN g ON g.series_id = t.series_id AND g.d = 0
  JOIN split s ON s.series_id = t.series_id AND s.pos = t.n_train
  WHERE t.role = 'test')
SELECT series_id, ts, step, round(actual, 6) AS actual, round(sarima, 6) AS sarima,
  round(sarima - half, 6) AS lower_95, round(sarima + half, 6) AS upper_95 FROM f""",
    ),
)
def sar_first_order_forecast(spark, d):
    s = weekly_split(spark, d)
    return sar.forecast(s, _refitted(s, SHAPE, FIRST_ORDER[:1]), SHAPE, 104)


def _refitted(s, shape, orders=None):
    """The winner of a list of orders, or of the full search, fitted on all its rows."""
    searched = (
        sar.two_stage_search(s, shape) if orders is None else sar.search_orders(s, orders, shape)
    )
    return sar.refit(s, sar.best_candidates(searched), shape).where("aic IS NOT NULL")


def _with_weather(s):
    """The searched orders of each series, fitted with its weather."""
    orders = sar.best_candidates(sar.two_stage_search(s, SHAPE)).select("series_id", *sar.ORDER)
    fits = sar.fit_candidates(sar.model_grams(s, WEATHER_SHAPE), orders, WEATHER_SHAPE)
    return sar.refit(s, fits.where("aic IS NOT NULL"), WEATHER_SHAPE).where("aic IS NOT NULL")


@query("sar_success_counts")
def sar_success_counts(spark, d):
    return sar.success_counts(sar.search_orders(weekly_split(spark, d), sar.order_grid(**GRID), SHAPE))


@query("sar_two_stage")
def sar_two_stage(spark, d):
    """The full search of 155 candidates per series."""
    return sar.search_display(sar.two_stage_search(weekly_split(spark, d), SHAPE))


@query("sar_best")
def sar_best(spark, d):
    return sar.best_summary(sar.best_candidates(sar.two_stage_search(weekly_split(spark, d), SHAPE)))


def _exact(spark, d):
    """The searched order of each series, fitted on exact residuals; the fit is stored."""
    s = weekly_split(spark, d)
    return s, kept(exact.refine(s, kept(_refitted(s, SHAPE), "refit"), SHAPE), "exact-fits")


@query("sar_exact_fit")
def sar_exact_fit(spark, d):
    """What exact residuals make of the searched orders: scores and estimates."""
    fits = _exact(spark, d)[1]
    return fits.select(
        "series_id", *sar.ORDER, "aic", "bic", "sigma2", "observations", "converged",
        F.concat_ws(",", F.transform("estimates", lambda e: F.format_number(e, 4))).alias("estimates"),
    )


@query("sar_exact_forecast")
def sar_exact_forecast(spark, d):
    s, fits = _exact(spark, d)
    left = exact.exact_residuals(s, fits, SHAPE)
    return sar.forecast(s, fits, SHAPE, 104, shocks=left)


@query("sar_exact_diagnostics")
def sar_exact_diagnostics(spark, d):
    s, fits = _exact(spark, d)
    return stats.residual_diagnostics(exact.exact_residuals(s, fits, SHAPE))


EXACT_AR_SQL = FIRST_ORDER_SQL.format(0) + """, f AS (
  SELECT t.series_id, t.ts, t.pos, t.y - phi * s.y AS y
  FROM split t JOIN g ON g.series_id = t.series_id AND g.d = 0
  JOIN split s ON s.series_id = t.series_id AND s.pos = t.pos - 1 WHERE t.role = 'train')"""


@query(
    "sar_exact_residuals",
    with_sql(EXACT_AR_SQL, "SELECT series_id, ts, pos, round(y, 6) AS y FROM f"),
)
def sar_exact_residuals(spark, d):
    """Of a first-order autoregression, whose least squares SQL can write down."""
    s = weekly_split(spark, d)
    fits = kept(exact.refine(s, kept(_refitted(s, SHAPE, FIRST_ORDER[:1]), "refit"), SHAPE), "exact-fits")
    return exact.exact_residuals(s, fits, SHAPE)


@query("sar_forecast")
def sar_forecast(spark, d):
    s = weekly_split(spark, d)
    best = _refitted(s, SHAPE)
    return sar.forecast(s, best, SHAPE, 104)


@query("sar_diagnostics")
def sar_diagnostics(spark, d):
    s = weekly_split(spark, d)
    best = _refitted(s, SHAPE)
    return stats.residual_diagnostics(sar.residuals(s, best, SHAPE))


@query("sarx_forecast")
def sarx_forecast(spark, d):
    s = _weather_split(spark, d)
    best = _with_weather(s)
    return sar.forecast(s, best, WEATHER_SHAPE, 104, "sarimax")


@query("sarx_coefficients")
def sarx_coefficients(spark, d):
    s = _weather_split(spark, d)
    best = _with_weather(s)
    return sar.coefficient_table(best, WEATHER_SHAPE)


def _tree_rows(spark, d):
    table = features.feature_table(model_rows(spark, d))
    return split.split_last(table, 104), predictors(table)


def _tree_fits(spark, d, *kinds):
    """The full published grids on four folds, every series; the grown trees' answers are stored."""
    ship_package(spark)
    s, names = _tree_rows(spark, d)
    grids = {k: trees.GRIDS[k] for k in kinds or trees.GRIDS}
    return s, names, grids, kept(trees.tree_fits(s, names, grids), "tree-fits")


def _search(spark, d, kind):
    _, _, grids, fits = _tree_fits(spark, d, kind)
    return trees.tree_scores(fits, grids).drop("point")


@query("rf_search")
def rf_search(spark, d):
    return _search(spark, d, "random_forest")


@query("gbt_search")
def gbt_search(spark, d):
    return _search(spark, d, "gradient_boosting")


@query("tree_forecast")
def tree_forecast(spark, d):
    """The searched forest and the searched boosted trees of each series."""
    s, _, grids, fits = _tree_fits(spark, d)
    return trees.searched_forecasts(s, fits, trees.tree_scores(fits, grids), grids)


def importance_table(spark, d):
    _, names, grids, fits = _tree_fits(spark, d)
    return trees.searched_importances(fits, trees.tree_scores(fits, grids), names)


@query("tree_importance")
def tree_importance(spark, d):
    return importance_table(spark, d)


HIDDEN = sequence.Hidden()


def _sequence_fits(s):
    """Linear models and hidden layers on sequences of a week of hours; a series too short for one
    has an error text and no forecast."""
    grams = sequence.sequence_grams(s, SEQUENCE_LENGTH, hidden=HIDDEN)
    return sequence.search(grams, SEQUENCE_LENGTH, hidden=HIDDEN)


def _rolling_forecast(s):
    best = sequence.best_fit(_sequence_fits(s))
    return sequence.rolling_forecast(s, best, SEQUENCE_LENGTH, hidden=HIDDEN)


@query(
    "seq_grams",
    with_sql(
        HOURLY_SPLIT,
        """, scales AS (
  SELECT series_id, min(y) AS mn,
    CASE WHEN max(y) = min(y) THEN 1.0 ELSE max(y) - min(y) END AS rg
  FROM split WHERE role = 'train' GROUP BY 1),
x AS (
  SELECT series_id, pos, n_train, (y - mn) / rg AS v,
    lag((y - mn) / rg, 1) OVER (PARTITION BY series_id ORDER BY pos) AS b1,
    lag((y - mn) / rg, 2) OVER (PARTITION BY series_id ORDER BY pos) AS b2
  FROM split JOIN scales USING (series_id) WHERE role = 'train'),
p AS (SELECT *, pos > n_train - floor((n_train - 2) * 0.15) AS held FROM x WHERE pos > 2)
SELECT s.series_id, count(p.v) FILTER (NOT held) AS train_rows,
  count(p.v) FILTER (held) AS validation_rows,
  round(coalesce(sum(v * v) FILTER (NOT held), 0), 6) AS train_yy,
  round(coalesce(sum(v * b1) FILTER (NOT held), 0), 6) AS train_y1,
  round(coalesce(sum(v * b2) FILTER (NOT held), 0), 6) AS train_y2,
  round(coalesce(sum(v * v) FILTER (held), 0), 6) AS held_yy,
  round(coalesce(sum(b1 * b2) FILTER (held), 0), 6) AS held_12
FROM scales s LEFT JOIN p ON p.series_id = s.series_id GROUP BY 1""",
    ),
)
def seq_grams(spark, d):
    """Cross products of two-step sequences; columns are target, constant, older, newer value."""
    g = sequence.sequence_grams(hourly_split(spark, d), 2)
    cells = {"train_yy": 0, "train_y1": 3, "train_y2": 2, "held_yy": 16, "held_12": 16 + 11}
    return g.select(
        "series_id",
        "train_rows",
        "validation_rows",
        *[F.col("gram")[i].alias(name) for name, i in cells.items()],
    )


@query("seq_search")
def seq_search(spark, d):
    return sequence.search_table(_sequence_fits(hourly_split(spark, d)))


@query("seq_history")
def seq_history(spark, d):
    return sequence.training_history(sequence.best_fit(_sequence_fits(hourly_split(spark, d))))


@query("seq_forecast")
def seq_forecast(spark, d):
    s = hourly_split(spark, d)
    return _rolling_forecast(s)


@query("seq_metrics")
def seq_metrics(spark, d):
    s = hourly_split(spark, d)
    return sequence.hourly_metrics(_rolling_forecast(s))


@query("history_panel")
def history_panel(spark, d):
    best = sequence.best_fit(_sequence_fits(hourly_split(spark, d)))
    return report.history_panel(sequence.training_history(best))


@query("residual_panel")
def residual_panel(spark, d):
    """The four residual views stacked: series, histogram, Q-Q and autocorrelation."""
    s = weekly_split(spark, d)
    best = _refitted(s, SHAPE)
    views = report.residual_panel(sar.residuals(s, best, SHAPE))
    pick = {
        "series": ("pos", "y"),
        "histogram": ("lower", "frequency"),
        "qq": ("theoretical", "ordered"),
        "acf": ("lag", "acf"),
    }
    parts = [
        views[v].select(
            "series_id",
            F.lit(v).alias("view"),
            F.col(x).cast("double").alias("x"),
            F.col(y).cast("double").alias("y"),
        )
        for v, (x, y) in pick.items()
    ]
    return evaluate.union_tables(*parts)
