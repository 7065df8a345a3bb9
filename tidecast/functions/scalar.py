"""Column expressions. All of them stay inside the JVM and none depends on the session time zone."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % point of the standard normal distribution.
Z_95 = 1.959963984540054

# Numerators and denominators of Wichura's algorithm AS 241 (1988), constant first,
# for the centre, the shoulders and the far tails.
NORMAL_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3),
)
NORMAL_SHOULDER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9),
)
NORMAL_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15),
)

ZONE_SUFFIX = r"(Z|UTC|[+-]\d{1,2}:\d{2})$"


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def week_end(ts: Column) -> Column:
    """Label of a Monday-to-Sunday week: its Sunday at 00:00."""
    return F.date_add(F.trunc(F.to_date(ts), "week"), 6).cast("timestamp_ntz")


def hour_start(ts: Column) -> Column:
    return day_start(ts) + F.make_dt_interval(hours=F.hour(ts))


GRAINS = {"hour": hour_start, "day": day_start, "week": week_end}


def coerce_double(value: Column) -> Column:
    """Numeric or missing: text that does not parse and NaN both become NULL."""
    return F.nullif(value.try_cast("double"), F.lit(float("nan")))


def coerce_timestamp(value: Column) -> Column:
    """UTC wall time or missing. Text with an offset is converted, text without one is UTC."""
    text = F.trim(value.cast("string"))
    instant = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz")
    )
    return F.when(text.rlike(ZONE_SUFFIX), instant).otherwise(text.try_cast("timestamp_ntz"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def clip_at_zero(value: Column) -> Column:
    """max(value, 0) that keeps a missing value missing."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def heating(temperature: Column, base: float) -> Column:
    return clip_at_zero(F.lit(base) - temperature)


def cooling(temperature: Column, base: float) -> Column:
    return clip_at_zero(temperature - F.lit(base))


def pretty_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def cycle_angle(week: Column, period: float = 52.0) -> Column:
    return F.lit(2.0 * math.pi) * week / F.lit(period)


def improvement_percent(reference: Column, value: Column) -> Column:
    return (reference - value) / reference * F.lit(100.0)


def guarded_scale(scale: Column, strict: bool = False) -> Column:
    """A scale that is not close to zero; else NULL, or an error at run time when strict."""
    ok = F.abs(scale) > F.lit(1e-8)
    if strict:
        return F.when(ok, scale).otherwise(
            F.raise_error(F.lit("the error to scale by is zero")).cast("double")
        )
    return F.when(ok, scale)


def checked(condition: Column, value: Column, message: str, strict: bool) -> Column:
    """``value`` where the condition holds; else NULL, or an error at run time when strict."""
    if strict:
        return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
    return F.when(condition, value)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, to the last digits of a double."""

    def ratio(parts, r: Column) -> Column:
        top, below = (
            reduce(lambda total, c: total * r + F.lit(c), reversed(p[:-1]), F.lit(p[-1])) for p in parts
        )
        return top / below

    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    tail = F.when(r <= 5.0, ratio(NORMAL_SHOULDER, r - 1.6)).otherwise(ratio(NORMAL_TAIL, r - 5.0))
    centre = ratio(NORMAL_CENTRE, F.lit(0.180625) - q * q) * q
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)


def stationarity_text(p_value: Column) -> Column:
    return F.when(
        p_value < 0.05, "Stationary: reject the null hypothesis of a unit root."
    ).when(p_value.isNotNull(), "Non-stationary: fail to reject the null hypothesis of a unit root.")


def chi_square_tail_even(statistic: Column, degrees: int) -> Column:
    """Upper tail of the chi-square distribution for an even number of degrees."""
    if degrees % 2:
        raise ValueError("The closed form needs an even number of degrees of freedom")
    half = statistic / 2.0
    terms: Iterable[Column] = (
        F.pow(half, F.lit(float(i))) / F.lit(float(math.factorial(i))) for i in range(degrees // 2)
    )
    total = F.lit(0.0)
    for term in terms:
        total = total + term
    return F.exp(-half) * total
