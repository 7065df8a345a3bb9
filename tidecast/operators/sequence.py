"""Hourly sequence forecaster: scale, cut sequences, search a model, forecast one step.

A model reads the previous ``length`` scaled values, and with them the answers of hidden layers
whose projections are drawn once from a seed; only its read-out is trained. The squared loss of a
read-out on any set of sequences is a quadratic form in one cross-product matrix, so Spark makes a
single pass that sums a training and a validation matrix per series; training epochs, validation
losses and the whole search are then computed from those two matrices. Smaller layers are the first
units of larger ones, so candidates of all sizes are parts of the same two matrices. Sequences are
never stored: each block of a series is cut into them inside its task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import numeric
from tidecast.functions.scalar import checked
from tidecast.operators.evaluate import error_metrics
from tidecast.operators.features import best_row, sequences
from tidecast.operators.layout import CHUNK, blocks, join_series, sum_arrays
from tidecast.operators.split import range_scales, scale_range, train_rows, validation_tail
from tidecast.schema import SEQUENCE_LENGTH, SERIES, TS, Y

# Training limits.
EPOCHS = 30
PATIENCE = 4
MIN_DELTA = 1e-5
VALIDATION = 0.15
PENALTIES = (0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)
# What the search tries of a hidden layer.
UNITS = (32, 64)
LAYERS = (1, 2)
DROPOUT = (0.1, 0.2)
HIDDEN_PENALTIES = (1e-5, 1e-3, 1e-1)

# Spread of what a hidden unit adds up before its tanh, for inputs of unit spread.
GAIN = 3.0


@dataclass(frozen=True)
class Hidden:
    """Hidden tanh layers with fixed random projections, drawn from ``seed``.

    All layers have ``max(units)`` units. A unit of a later layer reads the units below it that
    belong to the smallest size it is part of, so a layer of any size in ``units`` is the first
    units of the largest. ``layers=0`` is no hidden layer: the linear model alone.
    """

    units: tuple[int, ...] = UNITS
    layers: int = max(LAYERS)
    seed: int = 42

    @property
    def width(self) -> int:
        return max(self.units, default=0) if self.layers else 0

    def projections(self, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Weights and offsets of each layer for sequences of ``length`` values."""
        rng = np.random.default_rng([self.seed, length])
        sizes = np.sort(np.asarray(self.units, dtype=int))
        out = []
        for layer in range(self.layers if self.width else 0):
            if layer == 0:
                reads = np.ones((length, self.width), bool)
            else:
                own = sizes[np.searchsorted(sizes, np.arange(self.width), side="right")]
                reads = np.arange(self.width)[:, None] < own[None, :]
            drawn = rng.normal(size=reads.shape) * reads
            out.append((drawn * GAIN / np.sqrt(reads.sum(axis=0)), rng.uniform(-1, 1, self.width)))
        return out

    def columns(self, length: int, units: int, layers: int) -> np.ndarray:
        """Where a candidate's inputs lie: constant and values, then its units layer by layer."""
        first = 1 + length + self.width * np.arange(layers)[:, None]
        return np.concatenate([np.arange(1 + length), (first + np.arange(units)).ravel()])


LINEAR = Hidden((), 0)


def _inputs(matrix: np.ndarray, projections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The columns of ``_windows`` and then the answers of each hidden layer."""
    # Scaled values lie in 0..1; the first layer reads them around their middle.
    parts, below = [matrix], matrix[:, 2:] - 0.5
    for weights, offsets in projections:
        below = np.tanh(below @ weights + offsets)
        parts.append(below)
    return np.column_stack(parts) if len(parts) > 1 else matrix


@dataclass(frozen=True)
class Candidate:
    """``dropout`` falls on hidden units; ``penalty`` is the ridge of all weights but the constant."""

    units: int
    layers: int
    dropout: float
    penalty: float


def candidates(
    hidden: Hidden = LINEAR,
    penalties: Sequence[float] = PENALTIES,
    dropout: Sequence[float] = DROPOUT,
    hidden_penalties: Sequence[float] = HIDDEN_PENALTIES,
) -> list[Candidate]:
    """The linear models first, then every size, depth, dropout and penalty of ``hidden``."""
    linear = [Candidate(0, 0, 0.0, p) for p in penalties]
    deep = [
        Candidate(u, n, d, p)
        for u in hidden.units
        for n in range(1, hidden.layers + 1)
        for d in dropout
        for p in hidden_penalties
    ]
    return linear + deep


def supervised_sequences(
    split: DataFrame, length: int = SEQUENCE_LENGTH, fraction: float = VALIDATION,
    grain: str = "hour",
) -> DataFrame:
    """Scaled training sequences as arrays, with their target and train/validation part."""
    rows = train_rows(scale_range(split)).withColumn("n", F.col("n_train"))
    cut = sequences(rows, length, "scaled", grain)
    numbered = cut.withColumns({"pos": F.col("pos") - length, "n": F.col("n") - length})
    return validation_tail(numbered, fraction).select(
        SERIES, TS, "pos", "sequence", F.col("scaled").alias("target"), "part"
    )


def rolling_sequences(
    split: DataFrame, length: int, grain: str = "hour", strict: bool = False
) -> DataFrame:
    """For every test row, the ``length`` scaled values before it.

    Strict: a test row with fewer values before it is an error.
    """
    near = split.where(F.col("pos") > F.col("n_train") - length)
    rows = near_scaled(near, split)
    if strict:
        known = (F.col("role") != "test") | (F.col("pos") > length)
        message = "a test row has fewer values before it than a sequence holds"
        rows = rows.withColumn("scaled", checked(known, F.col("scaled"), message, True))
    cut = sequences(rows, length, "scaled", grain)
    return cut.where(F.col("role") == "test").select(
        SERIES, TS, "step", "sequence", F.col("scaled").alias("target")
    )


def near_scaled(near: DataFrame, split: DataFrame) -> DataFrame:
    """Some rows of ``split``, scaled by the training range of all."""
    return scale_range(near, scales=range_scales(split))


def _windows(values: np.ndarray, length: int) -> np.ndarray:
    """Columns: target, constant, the ``length`` values before it (oldest first)."""
    if len(values) <= length:
        return np.zeros((0, length + 2))
    cut = np.lib.stride_tricks.sliding_window_view(values, length + 1)
    return np.column_stack([cut[:, -1], np.ones(len(cut)), cut[:, :-1]])


def sequence_grams(
    split: DataFrame,
    length: int = SEQUENCE_LENGTH,
    fraction: float = VALIDATION,
    chunk: int = CHUNK,
    hidden: Hidden = LINEAR,
) -> DataFrame:
    """``series_id, train_rows, validation_rows, gram`` with both matrices in one array.

    Rows and columns of a matrix: target, constant, values, then the units of ``hidden``. Sums over
    blocks do not depend on their order, so models fitted to them are the same in every run.
    """
    layers = hidden.projections(length)
    rows = train_rows(scale_range(split)).withColumn("n", F.col("n_train"))
    cut = blocks(rows, length, ["scaled"], [], chunk)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [SERIES, "train_rows", "validation_rows", "gram"]
        sums = numeric.Partials()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                sid, start, n, pos, _, scaled = row
                held = int(max(n - length, 0) * fraction)
                matrix = _inputs(_windows(np.asarray(scaled, dtype=float), length), layers)
                target = np.asarray(pos)[length:] if len(matrix) else np.zeros(0)
                own = target > start
                late = target > n - held
                train, tail = matrix[own & ~late], matrix[own & late]
                flat = np.concatenate([numeric.gram(train), numeric.gram(tail)])
                sums.add((sid,), (len(train), len(tail)), numeric.exact_parts(flat))
                if sums.full():
                    yield pd.DataFrame(sums.drain(), columns=names)
        yield pd.DataFrame(sums.drain(), columns=names)

    parts = cut.mapInPandas(
        partial, f"{SERIES} string, train_rows long, validation_rows long, gram array<double>"
    )
    sums = sum_arrays(parts, [SERIES], "gram", ["train_rows", "validation_rows"])
    half = (F.size("gram") / 2).cast("int")
    upper, lower = F.slice("gram", 1, half), F.slice("gram", half + 1, half)
    return sums.withColumn("gram", F.zip_with(upper, lower, lambda a, b: a + b))


def _train(
    g: np.ndarray, rows: int, v: np.ndarray, held: int, penalty: float, limits,
    noise: np.ndarray | float = 0.0,
):
    """Conjugate-gradient epochs on the ridge loss with early stopping; best weights are kept.

    ``noise`` is the odds of each input being dropped: the squared loss averaged over all ways to
    drop inputs (the others scaled up) is the plain one plus a ridge of odds times mean square.
    """
    epochs, patience, min_delta = limits
    xx, xy, yy = g[1:, 1:] / rows, g[1:, 0] / rows, g[0, 0] / rows
    vxx, vxy, vyy = v[1:, 1:] / held, v[1:, 0] / held, v[0, 0] / held
    ridge = penalty + noise * np.diag(xx)
    ridge[0] = 0.0
    system = xx + np.diag(ridge)
    weights = np.zeros(len(xy))
    residual = xy - system @ weights
    direction, power = residual.copy(), residual @ residual
    history, best, kept, stale = [], np.inf, weights, 0
    for epoch in range(1, epochs + 1):
        if power > 0:
            moved = system @ direction
            rate = power / (direction @ moved)
            weights = weights + rate * direction
            residual = residual - rate * moved
            after = residual @ residual
            direction, power = residual + after / power * direction, after
        loss = float(yy - 2.0 * weights @ xy + weights @ xx @ weights)
        held_loss = float(vyy - 2.0 * weights @ vxy + weights @ vxx @ weights)
        history.append((epoch, max(loss, 0.0), max(held_loss, 0.0)))
        stale = 0 if held_loss < best - min_delta else stale + 1
        if held_loss < best:
            best, kept = held_loss, weights
        if stale >= patience:
            break
    return kept, history, min(h[2] for h in history)


SEARCH_SCHEMA = (
    f"{SERIES} string, candidate int, sequence_length int, units int, layers int, "
    "dropout double, penalty double, "
    "epochs_completed int, best_validation_loss double, error string, "
    "weights array<double>, history array<struct<epoch:int,loss:double,val_loss:double>>"
)


def search(
    grams: DataFrame,
    length: int = SEQUENCE_LENGTH,
    penalties: Sequence[float] = PENALTIES,
    epochs: int = EPOCHS,
    patience: int = PATIENCE,
    min_delta: float = MIN_DELTA,
    hidden: Hidden = LINEAR,
) -> DataFrame:
    """One row per series and candidate; series without enough rows get an error text.

    ``hidden`` must be what the matrices were made with.
    """
    tried = candidates(hidden, penalties)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SEARCH_SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for sid, rows, held, flat in zip(
                pdf[SERIES], pdf["train_rows"], pdf["validation_rows"], pdf["gram"]
            ):
                half = len(flat) // 2
                g, v = numeric.square(flat[:half]), numeric.square(flat[half:])
                for i, c in enumerate(tried):
                    head = (sid, i + 1, length, c.units, c.layers, c.dropout, c.penalty)
                    if rows < 1 or held < 1:
                        text = "the validation part is empty"
                        out.append((*head, None, None, text, None, None))
                        continue
                    own = hidden.columns(length, c.units, c.layers)
                    part = np.ix_(*[np.concatenate([[0], own + 1])] * 2)
                    noise = np.where(own > length, c.dropout / (1 - c.dropout), 0.0)
                    weights, history, loss = _train(
                        g[part], rows, v[part], held, c.penalty,
                        (epochs, patience, min_delta), noise,
                    )
                    cells = [dict(zip(("epoch", "loss", "val_loss"), h)) for h in history]
                    out.append((*head, len(history), loss, "", weights, cells))
            yield pd.DataFrame(out, columns=names).astype({"epochs_completed": "Int32"})

    return grams.mapInPandas(fit, SEARCH_SCHEMA)


def search_table(fits: DataFrame) -> DataFrame:
    return fits.drop("weights", "history").orderBy(
        SERIES, F.col("best_validation_loss").asc_nulls_last(), "candidate"
    )


def best_fit(fits: DataFrame) -> DataFrame:
    """Lowest validation loss per series; the earlier candidate wins a tie."""
    return best_row(
        fits.where("best_validation_loss IS NOT NULL"),
        [F.col("best_validation_loss"), F.col("candidate")],
    )


def training_history(best: DataFrame) -> DataFrame:
    return best.select(SERIES, F.inline("history"))


def rolling_forecast(
    split: DataFrame,
    best: DataFrame,
    length: int = SEQUENCE_LENGTH,
    name: str = "lstm",
    chunk: int = CHUNK,
    hidden: Hidden = LINEAR,
) -> DataFrame:
    """One-step forecast of every test row from the actual ``length`` rows before it.

    ``series_id, ts, actual, <name>`` in the units of the series; a row with too little history,
    or a series without a model, has no forecast.
    """
    layers = hidden.projections(length)
    carry = ["n_train", "scale_min", "scale_range"]
    near = split.where(F.col("pos") > F.col("n_train") - length)
    cut = blocks(near_scaled(near, split), length, ["scaled"], carry, chunk)
    work = join_series(cut, best.select(SERIES, "units", "layers", "weights"), F.col("start"), "left")

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                sid, start, _, n_train, low, span, pos, ts, values, units, depth, weights = row
                pos, values = np.asarray(pos), np.asarray(values, dtype=float)
                keep = (pos > start) & (pos > n_train)
                if not keep.any():
                    continue
                matrix = _windows(values, length)
                guess = np.full(len(pos), np.nan)
                if len(matrix) and weights is not None:
                    own = 1 + hidden.columns(length, int(units), int(depth))
                    guess[length:] = _inputs(matrix, layers)[:, own] @ np.asarray(weights)
                yield pd.DataFrame(
                    {
                        SERIES: sid,
                        TS: np.asarray(ts)[keep],
                        "actual": values[keep] * span + low,
                        name: guess[keep] * span + low,
                    }
                )

    return work.mapInPandas(
        predict, f"{SERIES} string, {TS} timestamp_ntz, actual double, `{name}` double"
    )


def hourly_metrics(forecasts: DataFrame, name: str = "lstm") -> DataFrame:
    return error_metrics(forecasts.select(SERIES, TS, "actual", name), [name]).withColumns(
        {
            "evaluation_frequency": F.lit("hourly"),
            "forecast_design": F.lit("rolling one-step-ahead"),
        }
    )
