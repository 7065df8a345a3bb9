"""Seasonal autoregression: candidate search, forecasts with intervals, covariates, diagnostics.

Each candidate (p, d, q)(P, D, Q, s) is a multiplicative seasonal model without intercept, fitted
by two regressions: a long autoregression gives residuals, then the differenced series is
regressed on its own lags, lagged residuals and differenced covariates. All candidates of a
series share one cross-product matrix per (d, D), summed by Spark over blocks of the series; a
candidate only reads the part it needs. So the data is read twice however large the grid is. All
candidates are scored on the same rows, which makes AIC comparable across differencing orders; the
chosen order is then fitted again on every row that order itself can use (``refit``).

Column names are ``p, d, q, sp, sd, sq, season`` because Spark does not tell ``p`` from ``P``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions import numeric
from tidecast.operators.features import best_row
from tidecast.operators.layout import CHUNK, blocks, join_series, sum_arrays
from tidecast.operators.split import test_rows, train_rows
from tidecast.schema import SERIES, TS, Y

ORDER = ("p", "d", "q", "sp", "sd", "sq")
ORDER_SCHEMA = "p int, d int, q int, sp int, sd int, sq int"

# The two search stages.
STAGE_ONE = {
    "p": range(0, 7),
    "d": range(0, 3),
    "q": range(0, 7),
    "sp": [1],
    "sd": [0],
    "sq": [1],
}
SEASONAL_STAGE = [
    (0, 0, 0),
    (1, 0, 0),
    (0, 0, 1),
    (1, 0, 1),
    (0, 1, 0),
    (1, 1, 0),
    (0, 1, 1),
    (1, 1, 1),
]


@dataclass(frozen=True)
class Shape:
    """Largest orders a search may use; they fix the lags of the shared matrix."""

    season: int = 52
    max_p: int = 6
    max_q: int = 6
    max_d: int = 2
    max_sd: int = 1
    long_lags: int = 13
    covariates: tuple[str, ...] = ()

    @property
    def ar_lags(self) -> list[int]:
        return [*range(1, self.max_p + 1), self.season] + [
            self.season + i for i in range(1, self.max_p + 1)
        ]

    @property
    def ma_lags(self) -> list[int]:
        return [*range(1, self.max_q + 1), self.season] + [
            self.season + i for i in range(1, self.max_q + 1)
        ]

    def residual_lags(self, sd: int) -> list[int]:
        """Lags of the long autoregression; a seasonal lag only where no difference removed it."""
        return [*range(1, self.long_lags + 1)] + ([] if sd else [self.season, self.season + 1])

    @property
    def first_row(self) -> int:
        """First position whose lags are defined for every candidate."""
        return self.max_d + self.max_sd * self.season + self.season + self.max_p + 1

    @property
    def lookback(self) -> int:
        longest = max(self.long_lags, self.season + 1)
        return self.max_d + self.max_sd * self.season + longest + self.season + max(
            self.max_p, self.max_q
        )

    @property
    def variants(self) -> list[tuple[int, int]]:
        return list(product(range(self.max_d + 1), range(self.max_sd + 1)))


def order_grid(p, d, q, sp, sd, sq) -> list[tuple[int, ...]]:
    return list(product(p, d, q, sp, sd, sq))


def with_orders(df: DataFrame, p, d, q, sp, sd, sq, season: int = 52) -> DataFrame:
    """Every row of a table once per candidate: the product of the six value lists."""
    out = df.withColumn("season", F.lit(season))
    for name, values in zip(ORDER, (p, d, q, sp, sd, sq)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(int(v)) for v in values])))
    return out.select(*df.columns, *ORDER, "season")


def grid_table(spark: SparkSession, p, d, q, sp, sd, sq, season: int = 52) -> DataFrame:
    """The candidate grid as a table."""
    return with_orders(spark.range(1).select(), p, d, q, sp, sd, sq, season)


# ------------------------------------------------------------------------------------ task helpers


def _long_rows(y: np.ndarray, x: np.ndarray, d: int, sd: int, shape: Shape):
    """Differenced target, and predictors of the long autoregression."""
    w = numeric.difference(y, d, sd, shape.season)
    xw = numeric.difference(x, d, sd, shape.season)
    return w, xw, np.column_stack([xw, numeric.lagged(w, shape.residual_lags(sd))])


def _residuals(w: np.ndarray, predictors: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Long-autoregression residuals; zero where the series is too young for them."""
    e = w - predictors @ beta
    return np.where(np.isfinite(e), e, 0.0)


def _model_rows(y, x, d, sd, shape: Shape, beta) -> np.ndarray:
    """Columns: target, covariates, target lags, residual lags."""
    w, xw, predictors = _long_rows(y, x, d, sd, shape)
    e = _residuals(w, predictors, beta)
    residual_lags = np.nan_to_num(numeric.lagged(e, shape.ma_lags))
    return np.column_stack([w, xw, numeric.lagged(w, shape.ar_lags), residual_lags])


def _used(order: Sequence[int], shape: Shape) -> np.ndarray:
    """Matrix columns an order reads. Residual lags are always defined, so they all count."""
    p, _, _, sp, _, _ = order
    short = [i < p for i in range(shape.max_p)]
    lags = [*short, bool(sp), *[bool(sp) and on for on in short]]
    return np.array([True] * (1 + len(shape.covariates)) + lags + [True] * len(shape.ma_lags))


def _order_rows(y, x, order: Sequence[int], shape: Shape, beta) -> np.ndarray:
    """The matrix of one order: columns it does not read are zero, so they exclude no early row."""
    matrix = _model_rows(y, x, order[1], order[4], shape, beta)
    matrix[:, ~_used(order, shape)] = 0.0
    return matrix


def _expand(theta: np.ndarray, order: Sequence[int], shape: Shape):
    """Coefficients of all matrix columns, and their Jacobian, from a candidate's parameters.

    Seasonal and short factors multiply: the lag s + i carries -phi_i * PHI or theta_j * THETA.
    """
    p, _, q, sp, _, sq = order
    k = len(shape.covariates)
    width = k + len(shape.ar_lags) + len(shape.ma_lags)
    beta, jac = np.zeros(width), np.zeros((width, len(theta)))
    for i in range(k):
        beta[i], jac[i, i] = theta[i], 1.0
    at = k
    for base, short, seasonal, top, sign in (
        (k, p, sp, shape.max_p, -1.0),
        (k + len(shape.ar_lags), q, sq, shape.max_q, 1.0),
    ):
        season_at = at + short
        for i in range(short):
            beta[base + i], jac[base + i, at + i] = theta[at + i], 1.0
        if seasonal:
            beta[base + top], jac[base + top, season_at] = theta[season_at], 1.0
            for i in range(short):
                cell = base + top + 1 + i
                beta[cell] = sign * theta[at + i] * theta[season_at]
                jac[cell, at + i] = sign * theta[season_at]
                jac[cell, season_at] = sign * theta[at + i]
        at = season_at + seasonal
    return beta, jac


def _fit(g: np.ndarray, rows: int, order: Sequence[int], shape: Shape) -> dict:
    """Gauss-Newton on the cross-product matrix; the first step is the additive regression."""
    p, _, q, sp, _, sq = order
    if p > shape.max_p or q > shape.max_q or sp > 1 or sq > 1:
        raise ValueError("order exceeds the search shape")
    count = len(shape.covariates) + p + q + sp + sq
    if rows <= count + 1:
        raise ValueError(f"too few observations: {rows}")
    yy, xy, xx = g[0, 0], g[1:, 0], g[1:, 1:]
    theta = np.zeros(count)

    def loss(t):
        b, j = _expand(t, order, shape)
        return yy - 2.0 * b @ xy + b @ xx @ b, b, j

    ssr, beta, jac = loss(theta)
    converged = count == 0
    for _ in range(50 if count else 0):
        hessian = jac.T @ xx @ jac
        if np.linalg.cond(hessian) > 1e14:
            raise np.linalg.LinAlgError("Singular matrix")
        step = np.linalg.solve(hessian, jac.T @ (xy - xx @ beta))
        scale, before = 1.0, ssr
        for _ in range(20):
            trial = loss(theta + scale * step)
            if trial[0] < ssr:
                theta, (ssr, beta, jac) = theta + scale * step, trial
                break
            scale /= 2.0
        if before - ssr <= 1e-10 * max(before, 1e-12):
            converged = True
            break
    if not ssr > 1e-12 * max(yy, 1e-300):
        raise np.linalg.LinAlgError("perfect fit")
    sigma2 = ssr / rows
    loglik, aic, bic = numeric.gaussian_scores(ssr, rows, count + 1)
    errors = np.array([])
    if count:
        cov = np.linalg.pinv(jac.T @ xx @ jac) * sigma2
        errors = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    return {
        "aic": aic,
        "bic": bic,
        "log_likelihood": loglik,
        "sigma2": sigma2,
        "observations": int(rows),
        "converged": bool(converged),
        "estimates": theta.tolist(),
        "errors": errors.tolist(),
    }


def _parameter_names(order: Sequence[int], shape: Shape) -> list[str]:
    p, _, q, sp, _, sq = order
    s = shape.season
    return (
        list(shape.covariates)
        + [f"ar.L{i}" for i in range(1, p + 1)]
        + ([f"ar.S.L{s}"] if sp else [])
        + [f"ma.L{i}" for i in range(1, q + 1)]
        + ([f"ma.S.L{s}"] if sq else [])
    )


def _polynomials(theta, order: Sequence[int], shape: Shape):
    """Weights of past values (differences included), of past residuals, and of covariates."""
    p, d, q, sp, sd, sq = order
    k, s = len(shape.covariates), shape.season
    gamma, phi = theta[:k], theta[k : k + p]
    big_phi = theta[k + p] if sp else 0.0
    rest = theta[k + p + sp :]
    small_theta, big_theta = rest[:q], (rest[q] if sq else 0.0)

    def seasonal(value: float, on: int) -> np.ndarray:
        out = np.zeros(s + 1)
        out[0], out[s] = 1.0, value * on
        return out

    unit = np.array([1.0])
    differ = unit
    for _ in range(d):
        differ = np.convolve(differ, [1.0, -1.0])
    for _ in range(sd):
        differ = np.convolve(differ, seasonal(-1.0, 1))
    ar = np.convolve(np.r_[1.0, -np.asarray(phi)], seasonal(-big_phi, sp) if sp else unit)
    ar = np.convolve(ar, differ)
    ma = np.convolve(np.r_[1.0, np.asarray(small_theta)], seasonal(big_theta, sq) if sq else unit)
    return -ar[1:], ma[1:], np.asarray(gamma), differ


def _project(y, e, x_all, theta, order, sigma2, horizon: int, shape: Shape):
    """Point forecasts and half widths. ``x_all`` covers the tail and the horizon."""
    past, shocks, gamma, differ = _polynomials(theta, order, shape)
    level = np.concatenate([y, np.zeros(horizon)])
    noise = np.concatenate([e, np.zeros(horizon)])
    effect = np.zeros(len(level))
    if len(gamma):
        raw = x_all @ gamma
        effect = np.convolve(raw, differ)[: len(raw)]
    start = len(y)
    psi = np.zeros(horizon)
    for h in range(horizon):
        t = start + h
        a, m = min(len(past), t), min(len(shocks), t)
        level[t] = (
            past[:a] @ level[t - 1 :: -1][:a] + shocks[:m] @ noise[t - 1 :: -1][:m] + effect[t]
        )
        if h == 0:
            psi[0] = 1.0
        else:
            back = min(len(past), h)
            psi[h] = past[:back] @ psi[h - 1 :: -1][:back]
            if h <= len(shocks):
                psi[h] += shocks[h - 1]
    with np.errstate(over="ignore"):
        width = np.sqrt(sigma2 * np.cumsum(psi**2))
    return level[start:], width


# --------------------------------------------------------------------------------------- operators


def _stack(row, shape: Shape) -> np.ndarray:
    if not shape.covariates:
        return np.zeros((len(row[Y]), 0))
    return np.column_stack([np.asarray(row[c], dtype=float) for c in shape.covariates])


def _train_blocks(split: DataFrame, shape: Shape, chunk: int, carry=()) -> DataFrame:
    rows = train_rows(split).withColumn("n", F.col("n_train"))
    return blocks(rows, shape.lookback, [Y, *shape.covariates], carry, chunk)


def long_regression(
    split: DataFrame, shape: Shape, variants=None, chunk: int = CHUNK
) -> DataFrame:
    """Long autoregression per series and differencing: ``series_id, d, sd, long_beta``."""
    pairs = list(variants or shape.variants)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sums = [SERIES, "d", "sd", "rows", "gram"], numeric.Partials()
        for pdf in batches:
            for _, row in pdf.iterrows():
                y, x = np.asarray(row[Y], dtype=float), _stack(row, shape)
                own = np.asarray(row["pos"]) > row["start"]
                for d, sd in pairs:
                    w, _, predictors = _long_rows(y, x, d, sd, shape)
                    matrix = np.column_stack([w, predictors])
                    keep = own & np.isfinite(matrix).all(axis=1)
                    flat = numeric.gram(matrix[keep])
                    sums.add((row[SERIES], d, sd), (int(keep.sum()),), flat)
                if sums.full():
                    yield pd.DataFrame(sums.drain(), columns=names)
        yield pd.DataFrame(sums.drain(), columns=names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            betas = []
            for flat in pdf["gram"]:
                g = numeric.square(flat)
                betas.append(np.linalg.lstsq(g[1:, 1:], g[1:, 0], rcond=1e-12)[0])
            yield pdf[[SERIES, "d", "sd"]].assign(long_beta=betas)

    parts = _train_blocks(split, shape, chunk).mapInPandas(
        partial, f"{SERIES} string, d int, sd int, rows long, gram array<double>"
    )
    summed = sum_arrays(parts, [SERIES, "d", "sd"], "gram", ["rows"])
    return summed.mapInPandas(solve, f"{SERIES} string, d int, sd int, long_beta array<double>")


def _betas_by_series(long_betas: DataFrame) -> DataFrame:
    return long_betas.groupBy(SERIES).agg(
        F.collect_list(F.struct("d", "sd", "long_beta")).alias("_betas")
    )


def model_grams(
    split: DataFrame, shape: Shape, variants=None, chunk: int = CHUNK
) -> DataFrame:
    """Cross products of all candidate columns per series and differencing.

    ``series_id, d, sd, rows, gram, long_beta``.
    """
    betas = long_regression(split, shape, variants, chunk)
    cut = join_series(
        _train_blocks(split, shape, chunk), _betas_by_series(betas), F.col("start")
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [SERIES, "d", "sd", "rows", "gram", "long_beta"]
        sums = numeric.Partials()
        for pdf in batches:
            for _, row in pdf.iterrows():
                y, x = np.asarray(row[Y], dtype=float), _stack(row, shape)
                pos = np.asarray(row["pos"])
                own = (pos > row["start"]) & (pos >= shape.first_row)
                for item in row["_betas"]:
                    d, sd, beta = item["d"], item["sd"], np.asarray(item["long_beta"])
                    matrix = _model_rows(y, x, d, sd, shape, beta)
                    keep = own & np.isfinite(matrix).all(axis=1)
                    flat = numeric.gram(matrix[keep])
                    sums.add((row[SERIES], d, sd), (int(keep.sum()),), flat, (beta,))
                if sums.full():
                    yield pd.DataFrame(sums.drain(), columns=names)
        yield pd.DataFrame(sums.drain(), columns=names)

    parts = cut.mapInPandas(
        partial,
        f"{SERIES} string, d int, sd int, rows long, gram array<double>, long_beta array<double>",
    )
    return sum_arrays(parts, [SERIES, "d", "sd"], "gram", ["rows"], ["long_beta"])


FIT_SCHEMA = (
    f"{SERIES} string, {ORDER_SCHEMA}, season int, aic double, bic double, "
    "log_likelihood double, sigma2 double, observations long, converged boolean, error string, "
    "estimates array<double>, errors array<double>, long_beta array<double>"
)


def fit_candidates(
    grams: DataFrame, candidates: DataFrame | Sequence[Sequence[int]], shape: Shape
) -> DataFrame:
    """One row per candidate, failed ones included with their error text.

    ``candidates`` is a list of orders tried on every series, or a table of orders per series. A
    table is gathered to one short list per series and (d, D), so that no matrix is copied per
    candidate.
    """
    shared: dict[tuple[int, int], list[tuple[int, ...]]] = {}
    if isinstance(candidates, DataFrame):
        keys = [SERIES, "d", "sd"]
        lists = candidates.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("p", "q", "sp", "sq"))).alias("_orders")
        )
        work = grams.join(lists, keys)
    else:
        for p, d, q, sp, sd, sq in candidates:
            shared.setdefault((d, sd), []).append((p, q, sp, sq))
        wanted = [(F.col("d") == d) & (F.col("sd") == sd) for d, sd in shared]
        work = grams.where(_any(wanted))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in FIT_SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                g = numeric.square(row["gram"])
                orders = shared.get((row["d"], row["sd"])) or [
                    (c["p"], c["q"], c["sp"], c["sq"]) for c in row["_orders"]
                ]
                for p, q, sp, sq in orders:
                    order = (p, row["d"], q, sp, row["sd"], sq)
                    record = {SERIES: row[SERIES], **dict(zip(ORDER, order))}
                    record |= {"season": shape.season, "long_beta": row["long_beta"]}
                    record |= {"converged": False, "error": "", "estimates": None, "errors": None}
                    try:
                        record |= _fit(g, int(row["rows"]), order, shape)
                    except (ValueError, np.linalg.LinAlgError) as problem:
                        record["error"] = str(problem)
                    out.append(record)
            yield pd.DataFrame(out, columns=names).astype({"observations": "Int64"})

    return work.mapInPandas(fit, FIT_SCHEMA)


def _any(conditions):
    combined = F.lit(False)
    for condition in conditions:
        combined = combined | condition
    return combined


def rank_candidates(search: DataFrame) -> DataFrame:
    """Display order: AIC, then BIC, failures last."""
    return search.orderBy(
        SERIES, F.col("aic").asc_nulls_last(), F.col("bic").asc_nulls_last(), *ORDER
    )


def ranked_candidates(search: DataFrame) -> DataFrame:
    """The display order as a column: ``rank`` within a series, a short list of candidates each."""
    order = [F.col("aic").asc_nulls_last(), F.col("bic").asc_nulls_last(), *ORDER]
    within = Window.partitionBy(SERIES).orderBy(*order)
    return search.withColumn("rank", F.row_number().over(within))


def best_candidates(search: DataFrame) -> DataFrame:
    """Lowest (AIC, BIC) per series among successful fits; convergence is not asked for."""
    return best_row(
        search.where("aic IS NOT NULL"),
        [F.col("aic"), F.col("bic"), *[F.col(c) for c in ORDER]],
    )


def require_success(search: DataFrame) -> DataFrame:
    """Fail when no candidate of any series was fitted. Runs a job; use on a stored search."""
    if search.where("aic IS NOT NULL").isEmpty():
        raise RuntimeError("No candidate model fitted successfully.")
    return search


def search_orders(
    split: DataFrame,
    candidates: Sequence[Sequence[int]],
    shape: Shape,
    chunk: int = CHUNK,
) -> DataFrame:
    """Fit a list of orders on every series."""
    variants = sorted({(c[1], c[4]) for c in candidates})
    return fit_candidates(model_grams(split, shape, variants, chunk), candidates, shape)


def two_stage_search(
    split: DataFrame,
    shape: Shape,
    stage_one: dict | None = None,
    seasonal: Sequence[tuple[int, int, int]] = SEASONAL_STAGE,
    grams: DataFrame | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Short orders with a fixed seasonal part, then seasonal parts around each series' winner.

    Both stages read ``grams``; pass a stored table to build it once.
    """
    if grams is None:
        grams = model_grams(split, shape, None, chunk)
    first = fit_candidates(grams, order_grid(**(stage_one or STAGE_ONE)), shape)
    winners = best_candidates(first).select(SERIES, "p", "d", "q")
    parts = F.array(
        *[
            F.struct(F.lit(a).alias("sp"), F.lit(b).alias("sd"), F.lit(c).alias("sq"))
            for a, b, c in seasonal
        ]
    )
    second = fit_candidates(grams, winners.select("*", F.inline(parts)), shape)
    return first.withColumn("search_stage", F.lit("non_seasonal_search")).unionByName(
        second.withColumn("search_stage", F.lit("seasonal_refinement"))
    )


def refit(split: DataFrame, best: DataFrame, shape: Shape, chunk: int = CHUNK) -> DataFrame:
    """The chosen order of every series, fitted on all training rows that the order can use.

    Same columns as a search; ``observations`` counts the rows. The common rows of a search start
    where its largest order does, which is right for comparing candidates and wasteful for one.
    """
    models = best.select(SERIES, F.struct(*ORDER, "long_beta").alias("_model"))
    cut = join_series(_train_blocks(split, shape, chunk), models, F.col("start"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [SERIES, "d", "sd", "rows", "gram", "long_beta"]
        sums = numeric.Partials()
        for pdf in batches:
            for _, row in pdf.iterrows():
                model = row["_model"]
                order = tuple(int(model[c]) for c in ORDER)
                beta = np.asarray(model["long_beta"])
                y, x = np.asarray(row[Y], dtype=float), _stack(row, shape)
                matrix = _order_rows(y, x, order, shape, beta)
                keep = (np.asarray(row["pos"]) > row["start"]) & np.isfinite(matrix).all(axis=1)
                key = (row[SERIES], order[1], order[4])
                sums.add(key, (int(keep.sum()),), numeric.gram(matrix[keep]), (beta,))
                if sums.full():
                    yield pd.DataFrame(sums.drain(), columns=names)
        yield pd.DataFrame(sums.drain(), columns=names)

    parts = cut.mapInPandas(
        partial,
        f"{SERIES} string, d int, sd int, rows long, gram array<double>, long_beta array<double>",
    )
    grams = sum_arrays(parts, [SERIES, "d", "sd"], "gram", ["rows"], ["long_beta"])
    return fit_candidates(grams, best.select(SERIES, *ORDER), shape)


def success_counts(search: DataFrame) -> DataFrame:
    """``series_id, candidates, fitted, converged``: how many candidates of a search succeeded."""
    return search.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count("aic").alias("fitted"),
        F.count_if("converged").alias("converged"),
    )


def search_display(search: DataFrame) -> DataFrame:
    """Published columns of a search, with the orders also as text."""
    order = F.format_string("(%d, %d, %d)", "p", "d", "q")
    seasonal = F.format_string("(%d, %d, %d, %d)", "sp", "sd", "sq", "season")
    tail = ["search_stage"] if "search_stage" in search.columns else []
    return search.select(
        SERIES,
        order.alias("order"),
        seasonal.alias("seasonal_order"),
        *ORDER,
        "season",
        "aic",
        "bic",
        "log_likelihood",
        "converged",
        "error",
        *tail,
    )


def best_summary(best: DataFrame) -> DataFrame:
    """Orders, as numbers and as text, with the scores of the chosen model."""
    return search_display(best).drop("search_stage", "converged", "error")


def forecast(
    split: DataFrame,
    best: DataFrame,
    shape: Shape,
    horizon: int,
    name: str = "sarima",
    shocks: DataFrame | None = None,
) -> DataFrame:
    """Test-row forecasts with 95 % limits: ``series_id, ts, step, actual, <name>, lower, upper``.

    Only the last rows a model looks back to, at most ``2 * lookback`` per series, are gathered;
    with covariates also their test values. A series without a model keeps its rows, unforecast.
    ``shocks`` (``series_id, pos, y``) are the model's residuals; without them those of the long
    autoregression stand in.
    """
    reach = 2 * shape.lookback
    columns = ["pos", Y, *shape.covariates]
    given = shocks is not None
    if given:
        left = shocks.select(SERIES, "pos", F.col(Y).alias("_shock"))
        split = split.join(left, [SERIES, "pos"], "left").withColumn("_shock", F.coalesce("_shock", F.lit(0.0)))
        best = best.withColumn("long_beta", F.lit(None).cast("array<double>"))
        columns.append("_shock")
    near = split.where(
        (F.col("pos") > F.col("n_train") - reach) & (F.col("pos") <= F.col("n_train") + horizon)
    )
    cell = F.struct(*columns, (F.col("role") == "test").alias("ahead"))
    tails = near.groupBy(SERIES).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    joined = tails.join(
        best.select(SERIES, *ORDER, "estimates", "sigma2", "long_beta"), SERIES
    )

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                cells = row["_cells"]
                ahead = np.array([c["ahead"] for c in cells])
                y = np.array([c[Y] for c in cells], dtype=float)[~ahead]
                x = np.array(
                    [[c[v] for v in shape.covariates] for c in cells], dtype=float
                ).reshape(len(cells), len(shape.covariates))
                order = tuple(int(row[c]) for c in ORDER)
                if not given:
                    w, _, predictors = _long_rows(y, x[~ahead], order[1], order[4], shape)
                    e = _residuals(w, predictors, np.asarray(row["long_beta"]))
                else:
                    e = np.array([c["_shock"] for c in cells], dtype=float)[~ahead]
                steps = int(ahead.sum())
                point, width = _project(
                    y, e, x, np.asarray(row["estimates"]), order, row["sigma2"], steps, shape
                )
                half = numeric.NORMAL.inv_cdf(0.975) * width
                for h in range(steps):
                    values = (point[h], point[h] - half[h], point[h] + half[h])
                    out.append((row[SERIES], h + 1, *(v if math.isfinite(v) else None for v in values)))
            yield pd.DataFrame(out, columns=[SERIES, "step", name, "lower_95", "upper_95"])

    steps = joined.mapInPandas(
        project, f"{SERIES} string, step long, `{name}` double, lower_95 double, upper_95 double"
    )
    tests = test_rows(split).select(SERIES, TS, "step", F.col(Y).alias("actual"))
    return tests.join(steps, [SERIES, "step"], "left").select(
        SERIES, TS, "step", "actual", name, "lower_95", "upper_95"
    )


def residuals(split: DataFrame, best: DataFrame, shape: Shape, chunk: int = CHUNK) -> DataFrame:
    """One-step residuals on all rows the order can use: ``series_id, ts, pos, y`` (the residual)."""
    models = best.select(
        SERIES,
        F.struct(*ORDER, "estimates", "long_beta").alias("_model"),
    )
    cut = join_series(_train_blocks(split, shape, chunk), models, F.col("start"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            frames = []
            for _, row in pdf.iterrows():
                model = row["_model"]
                order = tuple(int(model[c]) for c in ORDER)
                beta, _ = _expand(np.asarray(model["estimates"], dtype=float), order, shape)
                matrix = _order_rows(
                    np.asarray(row[Y], dtype=float),
                    _stack(row, shape),
                    order,
                    shape,
                    np.asarray(model["long_beta"]),
                )
                pos = np.asarray(row["pos"])
                keep = (pos > row["start"]) & np.isfinite(matrix).all(axis=1)
                if not keep.any():
                    continue
                frames.append(
                    pd.DataFrame(
                        {
                            SERIES: row[SERIES],
                            TS: np.asarray(row[TS])[keep],
                            "pos": pos[keep],
                            Y: matrix[keep, 0] - matrix[keep, 1:] @ beta,
                        }
                    )
                )
            if frames:
                yield pd.concat(frames, ignore_index=True)

    return cut.mapInPandas(apply, f"{SERIES} string, {TS} timestamp_ntz, pos long, {Y} double")


def coefficient_table(best: DataFrame, shape: Shape) -> DataFrame:
    """``series_id, parameter, estimate, standard_error, p_value`` with sigma2 last."""

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                order = tuple(int(row[c]) for c in ORDER)
                names = _parameter_names(order, shape) + ["sigma2"]
                rows = float(row["observations"])
                values = [*row["estimates"], row["sigma2"]]
                errors = [*row["errors"], row["sigma2"] * math.sqrt(2.0 / rows)]
                for i, (label, value, error) in enumerate(zip(names, values, errors)):
                    tail = float(numeric.normal_tail_two_sided(value / error)[0]) if error else None
                    out.append((row[SERIES], i + 1, label, value, error, tail))
            yield pd.DataFrame(
                out,
                columns=[SERIES, "position", "parameter", "estimate", "standard_error", "p_value"],
            )

    return best.mapInPandas(
        table,
        f"{SERIES} string, position int, parameter string, estimate double, "
        "standard_error double, p_value double",
    )
