"""The study as stored stages: each reads tables under one folder and writes its own there.

A stage's table is read back if it was made of the same: input files, parameters, code. A change
rebuilds the stages below it and no other. Writing between stages is also what keeps plans short and
lets a lost executor recompute one stage only.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import (
    baselines,
    clean,
    evaluate,
    exact,
    features,
    report,
    resample,
    sar,
    sequence,
    split,
    stats,
    trees,
)
from tidecast.schema import (
    HOURLY_HORIZON,
    SEQUENCE_LENGTH,
    SERIES,
    START_DATE,
    TS,
    WEATHER_COLUMNS,
    WEEKLY_HORIZON,
    WEEKLY_SEASON,
    Y,
    predictors,
    require_rows,
)
from tidecast.session import checkpoint_folder, ship_package
from tidecast.sources.readers import read_temperature
from tidecast.sources.sinks import manifest, profile, stored, table_exists, write_table


@dataclass
class Study:
    """Where the tables are and how the study is set up.

    Without a folder the tables go below the shared folder that the cluster names. The weather table
    describes all series, unless ``shared_weather`` is off: then it has rows per series.
    """

    spark: SparkSession
    folder: str | None = None
    horizon: int = WEEKLY_HORIZON
    season: int = WEEKLY_SEASON
    hourly_horizon: int = HOURLY_HORIZON
    length: int = SEQUENCE_LENGTH
    start: str = START_DATE
    shared_weather: bool = True
    force: bool = False
    tables: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ship_package(self.spark)
        if not self.folder:
            self.folder = f"{checkpoint_folder(self.spark).rstrip('/')}/study"

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def has(self, name: str) -> bool:
        return table_exists(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(f"Stage table not found: {self.path(name)}")
        return self.spark.read.parquet(self.path(name))

    def keep(self, name: str, build, /, *inputs: DataFrame, **parameters) -> DataFrame:
        """The stored table ``name``, built again if its inputs, parameters or code have changed."""
        self.tables[name] = self.path(name)
        return stored(self.spark, self.path(name), build, self.force, manifest(inputs, parameters))

    def export_csv(self, name: str) -> str:
        """A CSV copy of a stored table, next to it."""
        return write_table(self.read(name), self.path(f"{name}_csv"), "csv")


# ------------------------------------------------------------------------------------ data stages


def build_series(study: Study, raw: DataFrame) -> dict[str, DataFrame]:
    """Clean hourly load, and its daily and weekly means."""
    hourly = study.keep("hourly", lambda: clean.clean_load(raw, study.start), raw, start=study.start)
    return {
        "hourly": hourly,
        "daily": study.keep("daily", lambda: resample.daily_mean(hourly), hourly),
        "weekly": study.keep("weekly", lambda: resample.weekly_mean(hourly), hourly),
        "profile": study.keep("profile", lambda: profile(hourly, TS, Y, (SERIES,)), hourly),
    }


def build_weather(study: Study, raw_temperature: DataFrame) -> DataFrame:
    hourly = read_temperature(raw_temperature)
    return study.keep("weekly_weather", lambda: resample.weekly_weather(hourly), raw_temperature)


def build_model_table(study: Study) -> DataFrame:
    """Weekly load with the weather of its week.

    Weather is joined on time alone if the study's weather is shared by all series, else on the
    series too.
    """
    weather = study.read("weekly_weather")
    weather = weather.drop(SERIES) if study.shared_weather else weather
    table = study.keep(
        "weekly_model", lambda: resample.model_table(study.read("weekly"), weather), study.read("weekly"), weather
    )
    return require_rows(table, "Merged weekly load and weather table")


def build_feature_table(study: Study) -> DataFrame:
    return study.keep(
        "weekly_features", lambda: features.feature_table(study.read("weekly_model")), study.read("weekly_model")
    )


# -------------------------------------------------------------------------------- analysis stages


def explore(study: Study, lags: int = 60) -> dict[str, DataFrame]:
    """Summaries, differences, unit-root tests, correlation tables and the decomposition."""
    weekly = study.read("weekly")
    out = {
        f"{g}_summary": study.keep(
            f"{g}_summary",
            lambda g=g: stats.summary_statistics(study.read(g), bounded=g != "hourly"),
            study.read(g),
        )
        for g in ("hourly", "daily", "weekly")
    }
    diffs = study.keep("differences", lambda: features.differences(weekly, study.season), weekly, season=study.season)
    out["differences"] = diffs
    out["adf"] = study.keep("adf", lambda: stats.adf_of_differences(diffs), diffs)
    for column in (Y, "first_difference", "seasonal_difference"):
        for name, table in (("acf", stats.acf_table), ("pacf", stats.pacf_table)):
            key = f"{name}_{column}"
            out[key] = study.keep(
                key, lambda table=table, column=column: table(diffs, lags, column), diffs, lags=lags
            )
    out["decomposition"] = study.keep(
        "decomposition", lambda: stats.decompose(weekly, study.season), weekly, season=study.season
    )
    return out


def run_benchmarks(study: Study) -> dict[str, DataFrame]:
    marked = split.split_last(study.read("weekly"), study.horizon)
    weeks = dict(horizon=study.horizon, season=study.season)
    forecasts = study.keep(
        "benchmark_forecasts", lambda: baselines.baseline_forecasts(marked, study.season), marked, **weeks
    )
    metrics = study.keep(
        "benchmark_metrics",
        lambda: evaluate.rank_models(evaluate.evaluate(forecasts, marked, study.season)),
        forecasts,
        marked,
        **weeks,
    )
    return {"forecasts": forecasts, "metrics": metrics}


def _limits(table: DataFrame) -> DataFrame:
    return table.drop("lower_95", "upper_95")


def run_sar(
    study: Study, stage_one: dict | None = None, shape: sar.Shape | None = None
) -> dict[str, DataFrame]:
    """Two-stage order search, forecast, metrics, best-model summary and residual diagnostics."""
    shape = shape or sar.Shape(season=study.season)
    marked = split.split_last(study.read("weekly"), study.horizon)
    weeks = dict(horizon=study.horizon, shape=shape)
    grams = study.keep("sar_grams", lambda: sar.model_grams(marked, shape), marked, **weeks)
    search = study.keep(
        "sar_search",
        lambda: sar.two_stage_search(marked, shape, stage_one, grams=grams),
        grams,
        stage_one=stage_one,
        **weeks,
    )
    sar.require_success(search)
    best = study.keep("sar_best", lambda: sar.best_candidates(search), search)
    rough = study.keep("sar_fit", lambda: sar.refit(marked, best, shape), marked, best, **weeks)
    rough = rough.where("aic IS NOT NULL")
    chosen = study.keep("sar_exact_fit", lambda: exact.refine(marked, rough, shape), marked, rough, **weeks)
    left = study.keep(
        "sarima_residuals", lambda: exact.exact_residuals(marked, chosen, shape), marked, chosen, **weeks
    )
    forecast = study.keep(
        "sarima_forecast",
        lambda: sar.forecast(marked, chosen, shape, study.horizon, shocks=left),
        marked,
        chosen,
        left,
        **weeks,
    )
    metrics = study.keep(
        "sarima_metrics",
        lambda: evaluate.evaluate(_limits(forecast), marked, study.season),
        forecast,
        marked,
        **weeks,
    )
    return {
        "search": search,
        "summary": study.keep("sar_best_summary", lambda: sar.best_summary(best), best),
        "forecast": forecast,
        "metrics": metrics,
        "residuals": left,
        "diagnostics": study.keep(
            "sarima_diagnostics", lambda: stats.residual_diagnostics(left), left
        ),
    }


def run_sarx(study: Study, columns: Sequence[str] = WEATHER_COLUMNS) -> dict[str, DataFrame]:
    """The stored best orders refitted with standardised weather, and a conditional forecast."""
    names = tuple(f"{c}_scaled" for c in columns)
    shape = sar.Shape(season=study.season, covariates=names)
    marked = split.split_last(study.read("weekly_model"), study.horizon)
    scaled = split.standardise(marked, columns)
    orders = study.read("sar_best").select(SERIES, *sar.ORDER)
    weeks = dict(horizon=study.horizon, shape=shape)
    searched = study.keep(
        "sarx_search",
        lambda: sar.fit_candidates(sar.model_grams(scaled, shape), orders, shape),
        scaled,
        orders,
        **weeks,
    )
    best = study.keep(
        "sarx_fit",
        lambda: sar.refit(scaled, searched.where("aic IS NOT NULL"), shape),
        scaled,
        searched,
        **weeks,
    ).where("aic IS NOT NULL")
    forecast = study.keep(
        "sarimax_forecast",
        lambda: sar.forecast(scaled, best, shape, study.horizon, "sarimax"),
        scaled,
        best,
        **weeks,
    )
    return {
        "forecast": forecast,
        "metrics": study.keep(
            "sarimax_metrics",
            lambda: evaluate.evaluate(_limits(forecast), marked, study.season),
            forecast,
            marked,
            **weeks,
        ),
        "coefficients": study.keep(
            "sarimax_coefficients", lambda: sar.coefficient_table(best, shape), best, shape=shape
        ),
        "scaling": study.keep(
            "sarimax_scaling", lambda: split.scaling_table(marked, columns), marked, columns=columns, **weeks
        ),
    }


def run_trees(
    study: Study,
    forest_grid: dict | None = None,
    boost_grid: dict | None = None,
    splits: int = 4,
) -> dict[str, DataFrame]:
    """Tune both ensembles on every series, forecast, score, and report importances."""
    table = study.read("weekly_features")
    names = predictors(table)
    marked = split.split_last(table, study.horizon)
    grids = {
        "random_forest": forest_grid or trees.FOREST_GRID,
        "gradient_boosting": boost_grid or trees.BOOST_GRID,
    }
    tuned = dict(horizon=study.horizon, grids=grids, splits=splits)
    fits = study.keep("feature_fits", lambda: trees.tree_fits(marked, names, grids, splits), marked, **tuned)
    search = study.keep("feature_search", lambda: trees.tree_scores(fits, grids, splits), fits, **tuned)
    forecasts = study.keep(
        "feature_forecasts",
        lambda: trees.searched_forecasts(marked, fits, search, grids),
        marked,
        fits,
        search,
        **tuned,
    )
    return {
        "feature_forecasts": forecasts,
        "feature_metrics": study.keep(
            "feature_metrics",
            lambda: evaluate.evaluate(forecasts, marked, study.season),
            forecasts,
            marked,
            season=study.season,
            **tuned,
        ),
        "feature_importance": study.keep(
            "feature_importance", lambda: trees.searched_importances(fits, search, names), fits, search, names=names
        ),
        "feature_search": search,
    }


def run_sequence(study: Study, name: str = "lstm") -> dict[str, DataFrame]:
    """Sequence search on hourly data and the rolling one-step forecast of the test hours."""
    marked = split.split_last(study.read("hourly"), study.hourly_horizon, grain="hour")
    hidden = sequence.Hidden()
    hours = dict(horizon=study.hourly_horizon, length=study.length, hidden=repr(hidden))
    grams = study.keep(
        "sequence_grams",
        lambda: sequence.sequence_grams(marked, study.length, hidden=hidden),
        marked,
        **hours,
    )
    fits = study.keep(
        "sequence_fits",
        lambda: sequence.search(grams, study.length, hidden=hidden),
        grams,
        **hours,
    )
    best = sequence.best_fit(fits)
    forecast = study.keep(
        "sequence_forecast",
        lambda: sequence.rolling_forecast(marked, best, study.length, name, hidden=hidden),
        marked,
        fits,
        name=name,
        **hours,
    )
    return {
        "search": study.keep("sequence_search", lambda: sequence.search_table(fits), fits),
        "history": study.keep("sequence_history", lambda: sequence.training_history(best), fits),
        "forecast": forecast,
        "metrics": study.keep(
            "sequence_metrics", lambda: sequence.hourly_metrics(forecast, name), forecast, name=name
        ),
    }


def build_comparison(study: Study, name: str = "lstm") -> dict[str, DataFrame]:
    """All stored forecasts side by side and all metrics against seasonal naive."""
    benchmark = study.read("benchmark_forecasts")
    weekly_sequence = study.keep(
        "sequence_weekly_forecast",
        lambda: require_rows(
            evaluate.weekly_forecasts(study.read("sequence_forecast"), ["actual", name]),
            "Weekly sequence forecast",
        ),
        study.read("sequence_forecast"),
        name=name,
    )
    sequence_metrics = study.keep(
        "sequence_weekly_metrics",
        lambda: evaluate.sequence_weekly_metrics(weekly_sequence, benchmark, name),
        weekly_sequence,
        benchmark,
        name=name,
    )
    pieces = [
        ("benchmark_metrics", "operational"),
        ("sarima_metrics", "operational"),
        ("sarimax_metrics", "conditional"),
        ("feature_metrics", "conditional"),
    ]
    columns = [SERIES, "model", *evaluate.METRICS]
    tagged = [
        evaluate.tag(study.read(t).select(*columns), "weekly", kind) for t, kind in pieces
    ]
    tagged.append(evaluate.tag(sequence_metrics, "weekly", "rolling one-step-ahead"))
    comparison = study.keep(
        "model_comparison",
        lambda: evaluate.rank_models(evaluate.compare_models(evaluate.union_tables(*tagged))),
        *tagged,
    )
    renamed = weekly_sequence.select(SERIES, TS, F.col(name).alias("lstm_weekly"))
    combined = study.keep(
        "all_forecasts",
        lambda: evaluate.combine_forecasts(
            benchmark.drop("step"),
            study.read("sarima_forecast").select(SERIES, TS, "sarima"),
            study.read("sarimax_forecast").select(SERIES, TS, "sarimax"),
            study.read("feature_forecasts").select(
                SERIES, TS, "random_forest", "gradient_boosting"
            ),
            renamed,
        ),
        benchmark,
        study.read("sarima_forecast"),
        study.read("sarimax_forecast"),
        study.read("feature_forecasts"),
        renamed,
    )
    return {
        "comparison": comparison,
        "forecasts": combined,
        "panel": study.keep("comparison_panel", lambda: report.comparison_panel(combined), combined),
    }


# Every stage: the tables it reads, whether a plain run includes it, and what it does.
STAGES: dict[str, tuple[tuple[str, ...], bool, Callable[[Study, dict], object]]] = {
    "analysis": (("hourly", "daily", "weekly"), True, lambda study, _: explore(study)),
    "benchmarks": (("weekly",), True, lambda study, _: run_benchmarks(study)),
    "sarima": (("weekly",), True, lambda study, tuning: run_sar(study, tuning.get("stage_one"))),
    "sarimax": (("weekly_model", "sar_best"), True, lambda study, _: run_sarx(study)),
    "feature_models": (
        ("weekly_features",),
        True,
        lambda study, tuning: run_trees(
            study, tuning.get("forest_grid"), tuning.get("boost_grid"), tuning.get("splits", 4)
        ),
    ),
    "sequence": (("hourly",), False, lambda study, _: run_sequence(study)),
}


def prepare(study: Study, raw: DataFrame, raw_temperature: DataFrame) -> None:
    """The tables that all stages read, from raw load and temperature."""
    build_series(study, raw)
    build_weather(study, raw_temperature)
    build_model_table(study)
    build_feature_table(study)


def run_study(
    study: Study,
    raw: DataFrame | None = None,
    raw_temperature: DataFrame | None = None,
    stages: Collection[str] | None = None,
    **tuning,
) -> list[str]:
    """Run the named stages, or all that are on by default, in table order; returns their names.

    Raw tables, where given, are prepared first. ``tuning`` may hold ``stage_one``,
    ``forest_grid``, ``boost_grid`` and ``splits``. ``build_comparison`` is a call of its own.
    """
    unknown = set(stages or ()) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    if (raw is None) != (raw_temperature is None):
        raise ValueError("load and temperature are prepared together")
    ran = []
    if raw is not None:
        prepare(study, raw, raw_temperature)
        ran.append("preprocess")
    for name, (needs, default, run) in STAGES.items():
        if name in stages if stages is not None else default:
            for table in needs:
                study.read(table)
            run(study, tuning)
            ran.append(name)
    return ran
