"""Descriptive statistics, autocorrelation, unit-root test and seasonal decomposition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import numeric
from tidecast.functions.scalar import Z_95, chi_square_tail_even, stationarity_text
from tidecast.operators.clean import finite_only
from tidecast.operators.layout import (
    CHUNK,
    blocks,
    join_series,
    over_series,
    positions,
    sum_arrays,
)
from tidecast.schema import SERIES, TS, Y, require_columns

QUARTILES = (0.25, 0.5, 0.75)


def _ranked_cells(df: DataFrame, target: str, probabilities: Sequence[float], accuracy: int):
    """Exact order statistics around each probability, without sorting a whole series.

    A mergeable sketch brackets each wanted rank; values below the bracket are only counted, and
    just the distinct values inside it are put in order.
    """
    # The sketch errs by up to 1 / accuracy of the rows. Interpolation needs two ranks of slack:
    # where the margin is narrower than that, the bracket reaches out to the extremes.
    margin = 2.0 / accuracy
    wide = F.col("_n") * margin >= 2.0
    wanted = [
        b for p in probabilities for b in (max(p - margin, 0.0), min(p + margin, 1.0))
    ]
    sketch = F.percentile_approx(target, F.array(*[F.lit(p) for p in wanted]), F.lit(accuracy))
    brackets = df.groupBy(SERIES).agg(
        sketch.alias("_marks"),
        F.count(target).alias("_n"),
        F.min(target).alias("_min"),
        F.max(target).alias("_max"),
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(p).alias("p"),
                (F.lit(p) * (F.col("_n") - 1)).alias("h"),
                F.when(wide, F.col("_marks")[2 * i]).otherwise(F.col("_min")).alias("low"),
                F.when(wide, F.col("_marks")[2 * i + 1]).otherwise(F.col("_max")).alias("high"),
            )
            for i, p in enumerate(probabilities)
        ]
    )
    return brackets.select(SERIES, F.inline(cells))


def exact_percentiles(
    df: DataFrame,
    target: str = Y,
    probabilities: Sequence[float] = QUARTILES,
    accuracy: int = 10000,
) -> DataFrame:
    """Percentiles with linear interpolation: ``series_id`` and one column ``p<percent>`` each."""
    bounds = _ranked_cells(df, target, probabilities, accuracy)
    known = df.select(SERIES, F.col(target).alias("_v")).where("_v IS NOT NULL")
    joined = join_series(known, bounds, F.col("_v"))
    # Below the bracket: one counter row. Inside it: one row per distinct value.
    inside = (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
    counted = (
        joined.where(F.col("_v") <= F.col("high"))
        .withColumn("_slot", F.when(inside, F.col("_v")))
        .groupBy(SERIES, "p", "h", "_slot")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(SERIES, "p").orderBy(F.col("_slot").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = counted.withColumn("_last", F.sum("_c").over(w) - 1).withColumn(
        "_first", F.col("_last") - F.col("_c") + 1
    )
    lower, upper = F.floor("h"), F.ceil("h")
    holds = lambda rank: (F.col("_first") <= rank) & (rank <= F.col("_last"))
    picked = placed.groupBy(SERIES, "p").agg(
        F.max(F.when(holds(lower), F.col("_slot"))).alias("_lo"),
        F.max(F.when(holds(upper), F.col("_slot"))).alias("_hi"),
        F.max(F.col("h") - lower).alias("_f"),
    )
    missed = F.raise_error("a percentile lies outside the bracket of its sketch").cast("double")
    found = F.col("_lo").isNotNull() & F.col("_hi").isNotNull()
    value = F.when(
        found, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    ).otherwise(missed)
    return picked.groupBy(SERIES).agg(
        *[
            F.max(F.when(F.col("p") == p, value)).alias(f"p{round(p * 100)}")
            for p in probabilities
        ]
    )


def summary_statistics(df: DataFrame, target: str = Y, bounded: bool = False) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum, missing, first and last time.

    ``bounded=True`` is for weekly or daily tables, whose series fit one exact percentile buffer.
    """
    require_columns(df, [SERIES, TS, target])
    base = [
        F.count(target).alias("count"),
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"),
        F.min(target).alias("min"),
        F.max(target).alias("max"),
        F.count_if(F.col(target).isNull()).alias("missing"),
        F.min(TS).alias("start_date"),
        F.max(TS).alias("end_date"),
    ]
    order = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    order += ["missing", "start_date", "end_date"]
    if bounded:
        marks = F.percentile(target, F.array(*[F.lit(p) for p in QUARTILES]))
        stats = df.groupBy(SERIES).agg(*base, marks.alias("_marks"))
        names = {f"p{round(p * 100)}": F.col("_marks")[i] for i, p in enumerate(QUARTILES)}
        return stats.withColumns(names).select(SERIES, *order)
    stats = df.groupBy(SERIES).agg(*base)
    return stats.join(exact_percentiles(df, target), SERIES, "left").select(SERIES, *order)


def centred(df: DataFrame, target: str = Y, grain: str = "week") -> DataFrame:
    """Rows with a value, plus ``_c`` (value minus series mean) and ``_n``."""
    kept = df.where(F.col(target).isNotNull()).select(SERIES, TS, F.col(target).alias("_y"))
    if grain in ("week", "day"):
        whole = Window.partitionBy(SERIES)
        return kept.withColumns(
            {
                "_c": F.col("_y") - F.avg("_y").over(whole),
                "_n": F.count("_y").over(whole),
            }
        )
    means = kept.groupBy(SERIES).agg(F.avg("_y").alias("_m"), F.count("_y").alias("_n"))
    joined = join_series(kept, means)
    return joined.withColumn("_c", F.col("_y") - F.col("_m")).drop("_m")


def autocorrelation_wide(
    df: DataFrame,
    lags: int,
    target: str = Y,
    grain: str = "week",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """``series_id, n, acf`` with the array of biased autocorrelations at lags 0..lags.

    Lagged products are summed in numpy over blocks of the series, then by Spark; ``extra``
    aggregates over the value ``_y`` are added by series.
    """
    base = centred(df, target, grain)
    cut = blocks(positions(base, grain), lags, ["_c"])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                sid, start, _, pos, _, values = row
                c = np.asarray(values, dtype=float)
                own = int(np.searchsorted(np.asarray(pos), start, side="right"))
                sums = [c[own:] @ c[own:]]
                for k in range(1, lags + 1):
                    at = max(own, k)
                    sums.append(c[at:] @ c[at - k : len(c) - k] if at < len(c) else 0.0)
                out.append((sid, len(c) - own, sums))
            yield pd.DataFrame(out, columns=[SERIES, "n", "acf"])

    parts = cut.mapInPandas(products, f"{SERIES} string, n long, acf array<double>")
    sums = sum_arrays(parts, [SERIES], "acf", ["n"])
    total = F.col("acf")[0]
    wide = sums.select(
        SERIES, "n", F.transform("acf", lambda s: F.try_divide(s, total)).alias("acf")
    )
    return wide.join(base.groupBy(SERIES).agg(*extra), SERIES) if extra else wide


def acf_table(
    df: DataFrame, lags: int = 60, target: str = Y, grain: str = "week"
) -> DataFrame:
    """``series_id, lag, acf, lower_95, upper_95`` for lags 0..min(lags, n - 1), Bartlett band."""
    wide = autocorrelation_wide(df, lags, target, grain)
    cells = wide.select(SERIES, "n", F.posexplode("acf").alias("lag", "acf"), F.col("acf").alias("r"))
    cells = cells.where(F.col("lag") <= F.col("n") - 1)
    before = F.aggregate(
        F.slice("r", F.lit(2), F.greatest(F.col("lag") - 1, F.lit(0))),
        F.lit(0.0),
        lambda total, v: total + v * v,
    )
    half = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(
        F.lit(Z_95) * F.sqrt((1.0 + 2.0 * before) / F.col("n"))
    )
    return cells.select(
        SERIES,
        "lag",
        "acf",
        (F.col("acf") - half).alias("lower_95"),
        (F.col("acf") + half).alias("upper_95"),
    )


def pacf_table(
    df: DataFrame, lags: int = 60, target: str = Y, grain: str = "week"
) -> DataFrame:
    """Yule-Walker partial autocorrelations for lags 0..min(lags, max(1, n // 2 - 1))."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, n, acf in zip(pdf[SERIES], pdf["n"], pdf["acf"]):
                usable = min(lags, max(1, int(n) // 2 - 1))
                values = np.asarray(acf, dtype=float)[: usable + 1]
                half = Z_95 / np.sqrt(n)
                for k, v in enumerate(numeric.partial_autocorrelations(values)):
                    band = half if k else 0.0
                    out.append((sid, k, v, v - band, v + band))
            yield pd.DataFrame(out, columns=[SERIES, "lag", "pacf", "lower_95", "upper_95"])

    wide = autocorrelation_wide(df, lags, target, grain)
    return wide.mapInPandas(
        solve, f"{SERIES} string, lag int, pacf double, lower_95 double, upper_95 double"
    )


def _residual_moments(column: str) -> list[Column]:
    return [
        F.avg(column).alias("residual_mean"),
        F.stddev_samp(column).alias("residual_standard_deviation"),
    ]


def residual_summary(df: DataFrame, target: str = Y) -> DataFrame:
    return df.groupBy(SERIES).agg(*_residual_moments(target))


def residual_diagnostics(
    df: DataFrame, lags: int = 20, target: str = Y, grain: str = "week"
) -> DataFrame:
    """Mean, deviation and Ljung-Box test of the finite residuals, in one pass."""
    wide = autocorrelation_wide(
        finite_only(df, target), lags, target, grain, _residual_moments("_y")
    )
    return _ljung_box(wide, lags, ["residual_mean", "residual_standard_deviation"])


def ljung_box(
    df: DataFrame, lags: int = 20, target: str = Y, grain: str = "week"
) -> DataFrame:
    """``series_id, ljung_box_lag, ljung_box_statistic, ljung_box_p_value`` for an even lag count."""
    return _ljung_box(autocorrelation_wide(df, lags, target, grain), lags, [])


def _ljung_box(wide: DataFrame, lags: int, carry: Sequence[str]) -> DataFrame:
    n = F.col("n")
    total = F.lit(0.0)
    for k in range(1, lags + 1):
        total = total + F.pow(F.col("acf")[k], F.lit(2.0)) / F.nullif(n - k, F.lit(0))
    statistic = n * (n + 2) * total
    return wide.select(
        SERIES,
        *carry,
        F.lit(lags).alias("ljung_box_lag"),
        statistic.alias("ljung_box_statistic"),
        chi_square_tail_even(statistic, lags).alias("ljung_box_p_value"),
    )


def _unit_root_rows(values: np.ndarray, max_lag: int) -> np.ndarray:
    """Columns: difference, constant, previous level, differences at lags 1..max_lag."""
    change = numeric.difference(values, 1, 0, 1)
    level = numeric.lagged(values, [1])
    return np.column_stack(
        [change, np.ones(len(values)), level, numeric.lagged(change, range(1, max_lag + 1))]
    )


def _unit_root_gram(placed: DataFrame, chunk: int) -> DataFrame:
    """Summed cross products per series on the sample all its lag counts share.

    ``_lags`` is the largest lag count of the series. ``head`` keeps the ``_lags + 1`` values
    before that sample, which a shorter lag count can use as well.
    """
    cut = blocks(placed, F.col("_lags") + 2, [Y], ["_lags"], chunk)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sums = [SERIES, "_lags", "rows", "gram", "head"], numeric.Partials()
        for pdf in batches:
            for sid, start, _, max_lag, pos, _, values in pdf.itertuples(index=False):
                values, pos = np.asarray(values, dtype=float), np.asarray(pos)
                matrix = _unit_root_rows(values, int(max_lag))
                rows = matrix[(pos > start) & (pos >= max_lag + 2)]
                head = values[: max_lag + 1] if start == 0 else None
                sums.add((sid, int(max_lag)), (len(rows),), numeric.gram(rows), (head,))
                if sums.full():
                    yield pd.DataFrame(sums.drain(), columns=names)
        yield pd.DataFrame(sums.drain(), columns=names)

    parts = cut.mapInPandas(
        partial,
        f"{SERIES} string, _lags int, rows long, gram array<double>, head array<double>",
    )
    return sum_arrays(parts, [SERIES, "_lags"], "gram", ["rows"], ["head"])


def _solve(g: np.ndarray, size: int):
    """Coefficients, residual sum of squares and inverse of the leading ``size`` predictors."""
    inverse = np.linalg.inv(g[1 : size + 1, 1 : size + 1])
    beta = inverse @ g[1 : size + 1, 0]
    ssr = g[0, 0] - beta @ g[1 : size + 1, 0]
    return beta, max(ssr, 0.0), inverse


def _best_lag_count(g: np.ndarray, rows: int) -> int | None:
    """Lag count with the lowest AIC; none when no regression can be solved."""
    best, chosen = np.inf, None
    for size in range(2, g.shape[0]):
        if rows <= size:
            break
        try:
            ssr = _solve(g, size)[1]
        except np.linalg.LinAlgError:
            continue
        if ssr <= 1e-12 * g[0, 0] or ssr <= 0:
            continue
        aic = numeric.gaussian_scores(ssr, rows, size)[1]
        if aic < best:
            best, chosen = aic, size - 2
    return chosen


def adf_test(
    df: DataFrame,
    target: str = Y,
    name: Column | str | None = None,
    grain: str = "week",
    max_lags: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Unit-root test with a constant; the lag count minimises AIC on a common sample.

    ``max_lags`` lowers the largest lag count tried, which otherwise follows the series length.

    One pass over blocks of the series: only cross-product matrices leave them. The chosen lag
    count is refitted on its own longer sample by adding its few earlier rows to the matrix.
    """
    clean = df.where(F.col(target).isNotNull()).select(SERIES, TS, F.col(target).alias(Y))
    n = F.col("n")
    limit = F.greatest(
        F.least(F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 2), F.lit(0)
    ).cast("int")
    if max_lags is not None:
        limit = F.least(limit, F.lit(max_lags))
    placed = positions(clean, grain).withColumn("_lags", limit)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, top, rows, flat, head in zip(
                pdf[SERIES], pdf["_lags"], pdf["rows"], pdf["gram"], pdf["head"]
            ):
                g = numeric.square(flat)
                lags = _best_lag_count(g, rows)
                if lags is None:
                    out.append((sid, None, None, None, None))
                    continue
                size = lags + 2
                early = _unit_root_rows(np.asarray(head, dtype=float), lags)[lags + 1 :]
                g = g[: size + 1, : size + 1] + early.T @ early
                seen = int(rows + len(early))
                beta, ssr, inverse = _solve(g, size)
                tau = float(beta[1] / np.sqrt(ssr / (seen - size) * inverse[1, 1]))
                out.append((sid, tau, numeric.unit_root_p_value(tau), lags, seen))
            yield pd.DataFrame(
                out, columns=[SERIES, "adf_statistic", "p_value", "used_lags", "observations"]
            ).astype({"used_lags": "Int32", "observations": "Int64"})

    tested = _unit_root_gram(placed, chunk).mapInPandas(
        report,
        f"{SERIES} string, adf_statistic double, p_value double, used_lags int, observations long",
    )
    label = F.lit(name) if isinstance(name, str) else (F.col(SERIES) if name is None else name)
    return tested.select(
        SERIES,
        label.alias("series"),
        "adf_statistic",
        "p_value",
        "used_lags",
        "observations",
        stationarity_text(F.col("p_value")).alias("interpretation"),
    )


def adf_of_differences(diffs: DataFrame, target: str = Y, grain: str = "week") -> DataFrame:
    """The test on the series and its three differences, as one job over four stacked series."""
    # Row names of the stationarity report.
    names = {
        target: "Original weekly series",
        "first_difference": "First-differenced weekly series",
        "seasonal_difference": "Seasonally differenced weekly series",
        "first_seasonal_difference": "First and seasonally differenced weekly series",
    }
    stacked = diffs.unpivot([SERIES, TS], list(names), "_kind", "_value").where(
        "_value IS NOT NULL"
    )
    # Both names as one text, in which a missing series stays missing and no two pairs are alike.
    pair = F.to_json(F.struct(F.col(SERIES).alias("s"), F.col("_kind").alias("k")))
    keyed = stacked.select(pair.alias(SERIES), TS, F.col("_value").alias(Y))
    parts = F.from_json(F.col(SERIES), "s string, k string")
    tested = adf_test(keyed, grain=grain).withColumn("_pair", parts)
    tested = tested.withColumn("series", F.col("_pair.k")).withColumn(SERIES, F.col("_pair.s")).drop("_pair")
    labels = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return tested.withColumn("series", labels[F.col("series")])


def decompose(
    df: DataFrame, period: int = 52, target: str = Y, grain: str = "week", chunk: int = CHUNK
) -> DataFrame:
    """Additive seasonal decomposition.

    Trend: centred moving average, its ends extended by a line through the nearest ``period``
    trend points (at the end, those before the last one). Seasonal: mean detrended value per slot
    of the period, centred on zero. Averages run over chunks of positions, lines and slots are
    aggregates per series, so no task holds a series of a fine grain; results do not depend on the
    chunk size.
    """
    known = df.where(F.col(target).isNotNull()).select(SERIES, TS, F.col(target).alias("observed"))
    half = period // 2
    placed = positions(known, grain)
    # A row goes to every chunk in which some average reads it, before or behind.
    index = F.col("pos") - 1
    last_chunk = F.floor((F.col("n") - 1) / F.lit(chunk))
    first, last = (
        F.greatest(F.floor((index - half) / F.lit(chunk)), F.lit(0)),
        F.least(F.floor((index + half) / F.lit(chunk)), last_chunk),
    )
    cut = placed.withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(SERIES, "_chunk").orderBy("pos")
    frame = w.rowsBetween(-half, half)
    total = F.sum("observed").over(frame)
    if period % 2 == 0:
        ends = F.lag("observed", half).over(w) + F.lead("observed", half).over(w)
        total = total - 0.5 * ends
    full = F.count("observed").over(frame) == 2 * half + 1
    smooth = (
        cut.withColumn("_trend", F.when(full, total / float(period)))
        .where(F.floor(index / F.lit(chunk)) == F.col("_chunk"))
        .select(SERIES, TS, "observed", F.col("pos").cast("double"), F.col("n").cast("double"), "_trend")
    )
    begin, end = F.lit(half + 1.0), F.col("n") - half
    near_start = (F.col("pos") >= begin) & (F.col("pos") < F.least(begin + period, end))
    near_end = (F.col("pos") < end) & (F.col("pos") >= F.greatest(begin, end - period))

    def line(condition: Column, name: str) -> list[Column]:
        y = F.when(condition, F.col("_trend"))
        x = F.when(condition, F.col("pos"))
        return [F.regr_slope(y, x).alias(f"{name}1"), F.regr_intercept(y, x).alias(f"{name}0")]

    lines = smooth.groupBy(SERIES).agg(*line(near_start, "_s"), *line(near_end, "_e"))
    trend = (
        F.when(F.col("_trend").isNotNull(), F.col("_trend"))
        .when(F.col("pos") < begin, F.col("_s1") * F.col("pos") + F.col("_s0"))
        .otherwise(F.col("_e1") * F.col("pos") + F.col("_e0"))
    )
    slot = F.pmod(F.col("pos").cast("long") - 1, F.lit(period))
    fitted = join_series(smooth, lines).select(
        SERIES, TS, "observed", trend.alias("trend"), slot.cast("int").alias("_slot")
    )
    detrended = F.col("observed") - F.col("trend")
    means = fitted.groupBy(SERIES, "_slot").agg(F.avg(detrended).alias("_mean"))
    seasons = means.groupBy(SERIES).agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", "_mean"))).alias("_means"),
        (F.sum("_mean") / float(period)).alias("_centre"),
    )
    season = F.col("_means")[F.col("_slot")] - F.col("_centre")
    return join_series(fitted, seasons).select(
        SERIES,
        TS,
        "observed",
        "trend",
        season.alias("seasonal"),
        (detrended - season).alias("residual"),
    )
