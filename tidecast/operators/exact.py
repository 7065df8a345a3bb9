"""Seasonal models with moving averages fitted on their exact conditional residuals.

``sar`` takes lagged residuals from a long autoregression. Here they follow their own recursion,
``e_t = u_t - sum_j c_j e_(t-j)``, from zeros before the first usable row. A series may be longer than
a task should hold: a chunk of the recursion is an affine map of the residuals just before it, whose
matrix depends on the coefficients alone. Tasks compute each chunk's shift from a zero start, the
shifts of a series are added up in order to give every chunk its true start, and Gauss-Newton runs on
true residuals and derivatives. Nothing depends on the chunk size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import numeric
from tidecast.operators.layout import CHUNK, join_series, sum_arrays
from tidecast.operators.sar import ORDER, ORDER_SCHEMA, Shape, _polynomials, _stack, _train_blocks
from tidecast.schema import SERIES, TS, Y
from tidecast.session import kept

# A step is tried at these lengths at once.
SCALES = (1.0, 0.5, 0.1, 0.01)
MOST_STEPS, ENOUGH = 12, 1e-8
FIT_SCHEMA = (
    f"{SERIES} string, {ORDER_SCHEMA}, season int, aic double, bic double, log_likelihood double, "
    "sigma2 double, observations long, converged boolean, estimates array<double>, errors array<double>"
)
TRIED = f"{SERIES} string, trial int, order array<int>, theta array<double>"


def _split(theta: np.ndarray, order: Sequence[int], k: int):
    """Covariate, short and seasonal autoregressive, short and seasonal moving-average parameters."""
    p, _, q, sp, _, sq = order
    gamma, phi, rest = theta[:k], theta[k : k + p], theta[k + p :]
    return gamma, phi, (rest[0] if sp else 0.0), rest[sp : sp + q], (rest[sp + q] if sq else 0.0)


def _first(order: Sequence[int], season: int) -> int:
    """The first position that the order can use."""
    p, d, _, sp, sd, _ = order
    return d + sd * season + p + sp * season + 1


def _back(w: np.ndarray, lag: int) -> np.ndarray:
    out = np.full(len(w), np.nan)
    if lag < len(w):
        out[lag:] = w[: len(w) - lag]
    return out


def forcing(y, x, order: Sequence[int], theta: np.ndarray, shape: Shape) -> np.ndarray:
    """What drives the recursion, and its derivatives by covariates and autoregressive terms."""
    p, d, _, sp, sd, _ = order
    k, s = len(shape.covariates), shape.season
    gamma, phi, big, _, _ = _split(theta, order, k)
    w = numeric.difference(y, d, sd, s)
    xw = numeric.difference(x, d, sd, s)
    short = [_back(w, i) for i in range(1, p + 1)]
    long = [_back(w, s + i) for i in range(1, p + 1)] if sp else [np.zeros(len(w))] * p
    season = _back(w, s) if sp else np.zeros(len(w))
    u = w - xw @ gamma - big * season
    for a, b, c in zip(phi, short, long):
        u = u - a * b + a * big * c
    columns = [u, *(-xw.T), *(big * c - b for b, c in zip(short, long))]
    if sp:
        columns.append(sum((a * c for a, c in zip(phi, long)), -season))
    return np.column_stack(columns)


def filtered(drive: np.ndarray, taps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``out_t = drive_t - sum_j taps_j out_(t-j)`` by columns; ``start`` is what lies before."""
    m = len(taps)
    out = np.concatenate([start, drive])
    at = np.flatnonzero(taps)
    if len(at):
        weights, back = taps[at], at + 1
        with np.errstate(over="ignore", invalid="ignore"):
            for t in range(m, len(out)):
                out[t] -= weights @ out[t - back]
    return out


def _driven(row, order, theta, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The drive on a chunk's own rows, zeros where the order has no row yet; which rows count."""
    pos = np.asarray(row["pos"])
    own = pos > row["start"]
    drive = forcing(np.asarray(row[Y], dtype=float), _stack(row, shape), order, theta, shape)[own]
    used = (pos[own] >= _first(order, shape.season)) & np.isfinite(drive).all(axis=1)
    return np.where(used[:, None], drive, 0.0), used, own


def _taps(theta, order, shape: Shape) -> np.ndarray:
    return np.asarray(_polynomials(theta, order, shape)[1], dtype=float)


def _responses(taps: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk of ``rows``: what the residuals before it leave at its end, in the residuals and in
    the residuals filtered once more."""
    m = len(taps)
    once = filtered(np.zeros((rows, m)), taps, np.eye(m))
    twice = filtered(once[m:], taps, np.zeros((m, m)))
    return once[len(once) - m :], twice[len(twice) - m :]


def _starts(cut: DataFrame, tried: DataFrame, shape: Shape, chunk: int) -> DataFrame:
    """``series_id, trial, start, before``: the true state before every chunk, for every trial."""
    models = tried.groupBy(SERIES).agg(F.collect_list(F.struct("trial", "order", "theta")).alias("_trials"))

    def shifts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                for model in row["_trials"]:
                    order, theta = tuple(model["order"]), np.asarray(model["theta"], dtype=float)
                    drive, _, _ = _driven(row, order, theta, shape)
                    taps = _taps(theta, order, shape)
                    m = len(taps)
                    once = filtered(drive, taps, np.zeros((m, drive.shape[1])))
                    again = filtered(once[m:, :1], taps, np.zeros((m, 1)))
                    shift = np.column_stack([once[len(once) - m :], again[len(again) - m :]])
                    out.append((row[SERIES], model["trial"], row["start"], list(order), list(theta), shift.ravel()))
            yield pd.DataFrame(out, columns=[SERIES, "trial", "start", "order", "theta", "shift"])

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        """One short row per chunk of a series: they are taken in order."""
        pdf = pdf.sort_values("start")
        order, theta = tuple(pdf["order"].iloc[0]), np.asarray(pdf["theta"].iloc[0], dtype=float)
        taps = _taps(theta, order, shape)
        m = len(taps)
        once, twice = _responses(taps, chunk)
        state, befores = None, []
        with np.errstate(over="ignore", invalid="ignore"):
            for flat in pdf["shift"]:
                shift = np.asarray(flat, dtype=float).reshape(m, -1) if m else np.zeros((0, 1))
                state = np.zeros_like(shift) if state is None else state
                befores.append(state.ravel())
                moved = once @ state
                if m:
                    moved[:, -1] += twice @ state[:, 0]
                state = moved + shift
        return pdf[[SERIES, "trial", "start"]].assign(before=befores)

    parts = join_series(cut, models, F.col("start")).mapInPandas(
        shifts,
        f"{SERIES} string, trial int, start long, order array<int>, theta array<double>, shift array<double>",
    )
    return parts.groupBy(SERIES, "trial").applyInPandas(
        add_up, f"{SERIES} string, trial int, start long, before array<double>"
    )


def _exact_rows(row, model, before, shape: Shape):
    """Residuals and their derivatives on a chunk's own rows, and which rows count."""
    order, theta = tuple(model["order"]), np.asarray(model["theta"], dtype=float)
    drive, used, own = _driven(row, order, theta, shape)
    taps = _taps(theta, order, shape)
    m, s = len(taps), shape.season
    state = np.asarray(before, dtype=float).reshape(m, -1) if m else np.zeros((0, drive.shape[1] + 1))
    once = filtered(drive, taps, state[:, :-1])
    again = filtered(once[m:, :1], taps, state[:, -1:])[:, 0]
    _, _, q, _, _, sq = order
    *_, small, large = _split(theta, order, len(shape.covariates))
    lag = lambda i: again[m - i : len(again) - i]
    columns = [-(lag(i) + (large * lag(s + i) if sq else 0.0)) for i in range(1, q + 1)]
    if sq:
        columns.append(-(lag(s) + sum((a * lag(s + i) for i, a in enumerate(small, 1)), np.zeros(len(drive)))))
    return np.column_stack([once[m:], *columns]), used, own


def _with_starts(cut: DataFrame, tried: DataFrame, shape: Shape, chunk: int) -> DataFrame:
    befores = _starts(cut, tried, shape, chunk).join(tried, [SERIES, "trial"])
    trials = befores.groupBy(SERIES, "start").agg(
        F.collect_list(F.struct("trial", "order", "theta", "before")).alias("_trials")
    )
    return cut.join(trials, [SERIES, "start"])


def _evaluate(cut: DataFrame, tried: DataFrame, shape: Shape, chunk: int) -> DataFrame:
    """``tried`` with the rows and cross products of residuals and derivatives, summed by Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sums = [SERIES, "trial", "rows", "gram"], numeric.Partials()
        for pdf in batches:
            for _, row in pdf.iterrows():
                for model in row["_trials"]:
                    matrix, used, _ = _exact_rows(row, model, model["before"], shape)
                    with np.errstate(over="ignore", invalid="ignore"):
                        flat = numeric.gram(matrix[used])
                    sums.add((row[SERIES], model["trial"]), (int(used.sum()),), flat)
                if sums.full():
                    yield pd.DataFrame(sums.drain(), columns=names)
        yield pd.DataFrame(sums.drain(), columns=names)

    parts = _with_starts(cut, tried, shape, chunk).mapInPandas(
        partial, f"{SERIES} string, trial int, rows long, gram array<double>"
    )
    return tried.join(sum_arrays(parts, [SERIES, "trial"], "gram", ["rows"]), [SERIES, "trial"])


STATE = f"{SERIES} string, order array<int>, theta array<double>, rows long, gram array<double>, done boolean"


def _proposals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trials of a Gauss-Newton step from each series' present place."""
    for pdf in batches:
        out = []
        for _, row in pdf.iterrows():
            g, theta = numeric.square(row["gram"]), np.asarray(row["theta"], dtype=float)
            step = np.linalg.lstsq(g[1:, 1:], -g[1:, 0], rcond=1e-12)[0]
            for i, scale in enumerate(SCALES):
                out.append((row[SERIES], i, list(row["order"]), list(theta + scale * step)))
        yield pd.DataFrame(out, columns=[SERIES, "trial", "order", "theta"])


def refine(split: DataFrame, fits: DataFrame, shape: Shape, chunk: int = CHUNK) -> DataFrame:
    """The orders of ``fits`` fitted by least squares on exact residuals, starting at its estimates.

    Columns of a fit without ``long_beta``: scores, estimates, errors. A step is taken only where it
    lowers the sum of squares, so that never exceeds the start's. Series without a fit are left out.
    Two passes over the chunks per step, whatever the number of series; the chunks and every step's
    small table are stored. ``converged`` is false for a series still moving after the last step.
    """
    cut = kept(_train_blocks(split, shape, chunk), "blocks")
    known = fits.where("estimates IS NOT NULL")
    first = known.select(
        SERIES, F.lit(0).alias("trial"), F.array(*ORDER).alias("order"), F.col("estimates").alias("theta")
    )
    start = _evaluate(cut, kept(first, "trials"), shape, chunk)
    flat = F.size("theta") == 0
    now = kept(start.select(SERIES, "order", "theta", "rows", "gram", flat.alias("done")), "steps")
    for _ in range(MOST_STEPS):
        moving = now.where("NOT done")
        if moving.isEmpty():
            break
        tried = _evaluate(cut, kept(moving.mapInPandas(_proposals, TRIED), "trials"), shape, chunk)
        # Sums that are no numbers, from coefficients that let residuals explode, sort last.
        best = tried.where("NOT isnan(gram[0]) AND gram[0] < double('infinity')").groupBy(SERIES).agg(
            F.min_by(F.struct("theta", "gram"), F.struct(F.col("gram")[0], F.col("trial"))).alias("best")
        )
        joined = now.join(best, SERIES, "left")
        lower = F.coalesce(F.expr("best.gram[0] < gram[0] AND NOT done"), F.lit(False))
        ended = F.col("done") | ~lower | (F.expr("gram[0] - best.gram[0]") <= ENOUGH * F.col("gram")[0])
        now = kept(
            joined.select(
                SERIES,
                "order",
                F.when(lower, F.col("best.theta")).otherwise(F.col("theta")).alias("theta"),
                "rows",
                F.when(lower, F.col("best.gram")).otherwise(F.col("gram")).alias("gram"),
                ended.alias("done"),
            ),
            "steps",
        )

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in FIT_SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                g, rows, theta = numeric.square(row["gram"]), int(row["rows"]), list(row["theta"])
                if rows <= len(theta) + 1 or not g[0, 0] > 0:
                    continue
                loglik, aic, bic = numeric.gaussian_scores(g[0, 0], rows, len(theta) + 1)
                spread = np.linalg.pinv(g[1:, 1:]) * g[0, 0] / rows
                errors = np.sqrt(np.clip(np.diag(spread), 0.0, None)).tolist()
                cells = (aic, bic, loglik, g[0, 0] / rows, rows, bool(row["done"]), theta, errors)
                out.append((row[SERIES], *row["order"], shape.season, *cells))
            yield pd.DataFrame(out, columns=names)

    return now.mapInPandas(scores, FIT_SCHEMA)


def exact_residuals(split: DataFrame, fits: DataFrame, shape: Shape, chunk: int = CHUNK) -> DataFrame:
    """Exact one-step residuals on all rows the order can use: ``series_id, ts, pos, y``."""
    cut = _train_blocks(split, shape, chunk)
    tried = fits.where("estimates IS NOT NULL").select(
        SERIES, F.lit(0).alias("trial"), F.array(*ORDER).alias("order"), F.col("estimates").alias("theta")
    )

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                model = row["_trials"][0]
                matrix, used, own = _exact_rows(row, model, model["before"], shape)
                yield pd.DataFrame(
                    {
                        SERIES: row[SERIES],
                        TS: np.asarray(row[TS])[own][used],
                        "pos": np.asarray(row["pos"])[own][used],
                        Y: matrix[used, 0],
                    }
                )

    return _with_starts(cut, tried, shape, chunk).mapInPandas(
        apply, f"{SERIES} string, {TS} timestamp_ntz, pos long, {Y} double"
    )
