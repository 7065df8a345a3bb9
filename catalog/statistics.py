"""Autocorrelation, unit roots, decomposition and residual statistics."""

from catalog.base import HOURLY, SPLIT, WEEKLY, hourly, query, rounded, weekly, with_sql
from catalog.windows import W
from tidecast.operators import features, stats

LAGGED = (
    WEEKLY
    + """, centred AS (
  SELECT series_id, ts, y - avg(y) OVER (PARTITION BY series_id) AS c,
         row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos,
         count(*) OVER (PARTITION BY series_id) AS n FROM weekly),
ks AS (SELECT unnest(range(0, 61)) AS lag),
acf AS (
  SELECT a.series_id, k.lag, max(a.n) AS n,
         sum(a.c * b.c) / (SELECT sum(c * c) FROM centred z WHERE z.series_id = a.series_id) AS acf
  FROM centred a CROSS JOIN ks k
  JOIN centred b ON b.series_id = a.series_id AND b.pos = a.pos - k.lag
  GROUP BY a.series_id, k.lag)"""
)


@query(
    "acf",
    with_sql(
        LAGGED,
        """, b AS (
  SELECT *, CASE WHEN lag = 0 THEN 0.0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(
    sum(CASE WHEN lag > 0 THEN acf * acf ELSE 0 END) OVER (PARTITION BY series_id ORDER BY lag
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS half
  FROM acf)
SELECT series_id, lag, round(acf, 6) AS acf, round(acf - half, 6) AS lower_95,
  round(acf + half, 6) AS upper_95 FROM b""",
    ),
)
def acf(spark, d):
    return stats.acf_table(weekly(spark, d))


# Durbin-Levinson, one lag per step; lists hold the coefficients of the order reached.
PACF_SQL = (
    "WITH RECURSIVE "
    + LAGGED
    + """, r AS (
  SELECT series_id, max(n) AS n, list(acf ORDER BY lag) FILTER (lag > 0) AS r FROM acf GROUP BY 1),
steps AS (
  SELECT series_id, n, r, 1 AS k, [r[1]] AS phi FROM r
  UNION ALL
  SELECT series_id, n, r, k + 1,
    list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - x * phi[k + 1 - j]), [x])
  FROM (
    SELECT *, (r[k + 1] - list_dot_product(phi, list_reverse(r[1:k])))
              / (1 - list_dot_product(phi, r[1:k])) AS x
    FROM steps WHERE k < least(60, greatest(1, n // 2 - 1)))),
p AS (
  SELECT series_id, 0 AS lag, 1.0::DOUBLE AS pacf, 0.0::DOUBLE AS half FROM r
  UNION ALL SELECT series_id, k, phi[k], 1.959963984540054 / sqrt(n) FROM steps)
SELECT series_id, CAST(lag AS BIGINT) AS lag, round(pacf, 6) AS pacf,
  round(pacf - half, 6) AS lower_95, round(pacf + half, 6) AS upper_95 FROM p"""
)


@query("pacf", PACF_SQL)
def pacf(spark, d):
    return stats.pacf_table(weekly(spark, d))


@query(
    "pacf_short",
    with_sql(
        LAGGED,
        """, r AS (
  SELECT series_id, max(n) AS n, max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2,
         max(acf) FILTER (lag = 3) AS r3 FROM acf GROUP BY 1),
p AS (
  SELECT series_id, n, 0 AS lag, 1.0 AS pacf FROM r
  UNION ALL SELECT series_id, n, 1, r1 FROM r
  UNION ALL SELECT series_id, n, 2, (r2 - r1 * r1) / (1 - r1 * r1) FROM r
  UNION ALL SELECT series_id, n, 3,
    (r3 - 2 * r1 * r2 + r1 * r1 * r1 - r1 * r1 * r3 + r1 * r2 * r2)
    / (1 - 2 * r1 * r1 + 2 * r1 * r1 * r2 - r2 * r2) FROM r)
SELECT series_id, CAST(lag AS BIGINT) AS lag, round(pacf, 6) AS pacf,
  round(pacf - CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 / sqrt(n) END, 6) AS lower_95,
  round(pacf + CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 / sqrt(n) END, 6) AS upper_95
FROM p""",
    ),
)
def pacf_short(spark, d):
    """Lags with a closed form."""
    return stats.pacf_table(weekly(spark, d), 3)


@query("adf")
def adf(spark, d):
    return stats.adf_test(weekly(spark, d))


def _sweep_sql(name: str, grams: str, keep: str) -> str:
    """Gauss-Jordan sweeps of the cross products in ``grams``, one predictor per step.

    After step k the cell (1000, 1000) is the residual sum of squares of the first k predictors,
    (i, 1000) their coefficients and (i, i) the diagonal of their inverse cross product.
    """
    return f"""{name} AS (
  SELECT series_id, 0 AS k, top, i, j, v FROM {grams}
  UNION ALL
  SELECT series_id, k + 1, top, i, j,
    CASE WHEN i = k AND j = k THEN 1 / d WHEN i = k THEN v / d WHEN j = k THEN -v / d
         ELSE v - a * b / d END
  FROM (
    SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY series_id) AS d,
           max(CASE WHEN j = k THEN v END) OVER (PARTITION BY series_id, i) AS a,
           max(CASE WHEN i = k THEN v END) OVER (PARTITION BY series_id, j) AS b
    FROM {name} WHERE k <= top + 1)),
{name}_end AS (SELECT * FROM {name} WHERE {keep})"""


ADF_SQL = (
    "WITH RECURSIVE "
    + WEEKLY
    + f""", ns AS (
  SELECT series_id, ts, y, row_number() OVER {W} AS t, y - lag(y, 1) OVER {W} AS dy,
         lag(y, 1) OVER {W} AS b, count(*) OVER (PARTITION BY series_id) AS n FROM weekly),
lim AS (
  SELECT DISTINCT series_id, n,
    greatest(least(ceil(12.0 * power(n / 100.0::DOUBLE, 0.25::DOUBLE)), n // 2 - 2), 0)::BIGINT AS top
  FROM ns),
z AS (
  SELECT series_id, t, 0 AS i, 1.0::DOUBLE AS v FROM ns WHERE t >= 2
  UNION ALL SELECT series_id, t, 1, b FROM ns WHERE t >= 2
  UNION ALL SELECT series_id, t, 1000, dy FROM ns WHERE t >= 2
  UNION ALL
  SELECT a.series_id, a.t + l.l, 1 + l.l, a.dy
  FROM ns a JOIN lim ON lim.series_id = a.series_id
  JOIN (SELECT unnest(range(1, 60)) AS l) l ON l.l <= lim.top AND a.t + l.l <= lim.n
  WHERE a.t >= 2),
common AS (
  SELECT x.series_id, any_value(lim.top) AS top, x.i, y.i AS j, sum(x.v * y.v) AS v
  FROM z x JOIN z y ON x.series_id = y.series_id AND x.t = y.t
  JOIN lim ON lim.series_id = x.series_id AND x.t >= lim.top + 2 GROUP BY x.series_id, x.i, y.i),
"""
    + _sweep_sql("nested", "common", "i = 1000 AND j = 1000 AND k >= 2")
    + """,
aic AS (
  SELECT e.series_id, k - 2 AS lags,
    (n - lim.top - 1) * ln(v / (n - lim.top - 1)) + 2 * k AS aic
  FROM nested_end e JOIN lim USING (series_id)),
best AS (SELECT series_id, arg_min(lags, aic) AS lags FROM aic GROUP BY 1),
own AS (
  SELECT x.series_id, any_value(best.lags) AS top, x.i, y.i AS j, sum(x.v * y.v) AS v
  FROM z x JOIN z y ON x.series_id = y.series_id AND x.t = y.t
  JOIN best ON best.series_id = x.series_id AND x.t >= best.lags + 2
    AND (x.i <= best.lags + 1 OR x.i = 1000) AND (y.i <= best.lags + 1 OR y.i = 1000)
  GROUP BY x.series_id, x.i, y.i),
"""
    + _sweep_sql("refit", "own", "k = top + 2")
    + """
SELECT series_id,
  round(max(v) FILTER (i = 1 AND j = 1000)
    / sqrt(max(v) FILTER (i = 1000 AND j = 1000) / (n - lags - 1 - (lags + 2))
           * max(v) FILTER (i = 1 AND j = 1)), 6) AS adf_statistic,
  CAST(lags AS BIGINT) AS used_lags, CAST(n - lags - 1 AS BIGINT) AS observations
FROM refit_end JOIN lim USING (series_id) JOIN best USING (series_id)
GROUP BY series_id, lags, n"""
)


@query("adf_statistics", ADF_SQL)
def adf_statistics(spark, d):
    """The test with its lag choice; the p-value needs a normal distribution, which SQL lacks."""
    return stats.adf_test(weekly(spark, d)).select(
        "series_id", "adf_statistic", "used_lags", "observations"
    )


@query(
    "adf_zero_lags",
    with_sql(
        WEEKLY,
        f""", c AS (SELECT series_id, y - lag(y, 1) OVER {W} AS dy, lag(y, 1) OVER {W} AS b FROM weekly),
r AS (
  SELECT series_id, regr_count(dy, b) AS n, regr_slope(dy, b) AS slope, regr_sxx(dy, b) AS sxx,
         regr_syy(dy, b) - regr_slope(dy, b) * regr_sxy(dy, b) AS ssr FROM c GROUP BY 1)
SELECT series_id, round(slope / sqrt(ssr / (n - 2) / sxx), 6) AS adf_statistic,
  CAST(0 AS BIGINT) AS used_lags, CAST(n AS BIGINT) AS observations FROM r""",
    ),
)
def adf_zero_lags(spark, d):
    """Without lagged differences the test is one simple regression."""
    return stats.adf_test(weekly(spark, d), max_lags=0).select(
        "series_id", "adf_statistic", "used_lags", "observations"
    )


@query("adf_differences")
def adf_differences(spark, d):
    return stats.adf_of_differences(features.differences(weekly(spark, d)))


TERMS = " + ".join(
    ["1.0"] + [f"power(q / 2, {i}) / {i_fact}" for i, i_fact in (
        (1, "1.0"), (2, "2.0"), (3, "6.0"), (4, "24.0"), (5, "120.0"), (6, "720.0"),
        (7, "5040.0"), (8, "40320.0"), (9, "362880.0"),
    )]
)


@query(
    "ljung_box",
    with_sql(
        LAGGED,
        f""", lb AS (
  SELECT series_id, max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS q
  FROM acf WHERE lag BETWEEN 1 AND 20 GROUP BY 1)
SELECT series_id, CAST(20 AS BIGINT) AS ljung_box_lag, round(q, 6) AS ljung_box_statistic,
  round(exp(-q / 2) * ({TERMS}), 6) AS ljung_box_p_value FROM lb""",
    ),
)
def ljung_box(spark, d):
    return stats.ljung_box(weekly(spark, d))


def _decompose_sql(ctes: str, source: str, period: int) -> str:
    """For an even period."""
    half, after = period // 2, period // 2 + 1
    frame = f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    start = f"FILTER (pos >= {after} AND pos < least({after + period}, n - {half}))"
    end = f"FILTER (pos < n - {half} AND pos >= greatest({after}, n - {half + period}))"
    return with_sql(
        ctes,
        f""", t AS (
  SELECT series_id, ts, y AS observed, row_number() OVER {W} AS pos,
    count(*) OVER (PARTITION BY series_id) AS n,
    CASE WHEN count(y) {frame} = {period + 1} THEN
      (sum(y) {frame} - 0.5 * (lag(y, {half}) OVER {W} + lead(y, {half}) OVER {W})) / {period}.0
    END AS smooth
  FROM {source}),
ends AS (
  SELECT series_id,
    regr_slope(smooth, pos) {start} AS s1, regr_intercept(smooth, pos) {start} AS s0,
    regr_slope(smooth, pos) {end} AS e1, regr_intercept(smooth, pos) {end} AS e0
  FROM t GROUP BY 1),
u AS (
  SELECT t.*, (pos - 1) % {period} AS slot,
    CASE WHEN smooth IS NOT NULL THEN smooth WHEN pos < {after} THEN s1 * pos + s0
         ELSE e1 * pos + e0 END AS trend
  FROM t JOIN ends USING (series_id)),
m AS (SELECT series_id, slot, avg(observed - trend) AS v FROM u GROUP BY 1, 2),
s AS (SELECT series_id, slot, v - avg(v) OVER (PARTITION BY series_id) AS seasonal FROM m)
SELECT series_id, ts, {rounded('observed', 'trend', 'seasonal')},
  round(observed - trend - seasonal, 6) AS residual
FROM u JOIN s USING (series_id, slot)""",
    )


@query("decompose", _decompose_sql(WEEKLY, "weekly", 52))
def decompose(spark, d):
    return stats.decompose(weekly(spark, d))


@query("decompose_hourly", _decompose_sql(HOURLY, "hourly", 24))
def decompose_hourly(spark, d):
    """The daily pattern of hourly series, cut into chunks."""
    return stats.decompose(hourly(spark, d), 24, grain="hour", chunk=256)


@query(
    "residual_summary",
    with_sql(
        SPLIT,
        f""", r AS (SELECT series_id, y - lag(y, 1) OVER {W} AS e FROM split)
SELECT series_id, round(avg(e), 6) AS residual_mean,
  round(stddev_samp(e), 6) AS residual_standard_deviation FROM r GROUP BY 1""",
    ),
)
def residual_summary(spark, d):
    moved = features.differences(weekly(spark, d))
    return stats.residual_summary(moved, "first_difference")


