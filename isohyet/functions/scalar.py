"""Scalar functions as Column expressions: normal distribution, clipping, units, counter-based random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of P. J. Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

#: Spellings of units (without case, blanks, signs of powers and underscores), and the affine conversion
#: (scale, offset) of each group to the variable's canonical unit.
UNITS = {
    "PRCP": {
        "mmd-1 mm/day mmday-1 mm/d mm kgm-2d-1 kgm-2day-1 kg/m2/day": (1.0, 0.0),
        "kgm-2s-1 kg/m2/s mms-1 mm/s": (86400.0, 0.0),
        "m md-1 m/day mday-1": (1000.0, 0.0),
        "ms-1 m/s": (86400000.0, 0.0),
    },
    "TMIN": {
        "degc c celsius degreecelsius degreescelsius degreec degreesc": (1.0, 0.0),
        "k kelvin degreekelvin degreeskelvin": (1.0, -273.15),
        "degf f fahrenheit": (5.0 / 9.0, -32.0 * 5.0 / 9.0),
    },
    "HUMIN": {"% percent percentage pct": (1.0, 0.0), "1 fraction dimensionless 0-1": (100.0, 0.0)},
    "WIND": {"ms-1 m/s msec-1 meter/second metrespersecond": (1.0, 0.0), "kmh-1 km/h kph": (1.0 / 3.6, 0.0), "knot knots kt kts": (0.5144444444444445, 0.0)},
    "SOLAR": {"mjm-2d-1 mj/m2/day mjm-2day-1 mjm-2 mj/m2": (1.0, 0.0), "wm-2 w/m2": (0.0864, 0.0), "jm-2 j/m2 jm-2d-1 j/m2/day": (1e-6, 0.0), "kjm-2 kj/m2 kjm-2d-1": (1e-3, 0.0)},
}
UNITS |= {"TMAX": UNITS["TMIN"], "HUMAX": UNITS["HUMIN"]}
#: The coefficients of G. West's double precision cumulative normal distribution (2005).
WEST_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
WEST_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution, relative error below 1.2e-9; null outside (0, 1)."""
    low = 0.02425
    tail = lambda q: _polynomial(ACKLAM_C, q) / (_polynomial(ACKLAM_D, q) * q + 1.0)
    centre, square = p - 0.5, (p - 0.5) * (p - 0.5)
    middle = _polynomial(ACKLAM_A, square) * centre / (_polynomial(ACKLAM_B, square) * square + 1.0)
    inside = (p > 0) & (p < 1)
    return F.when(inside & (p < low), tail(F.sqrt(-2.0 * F.ln(p)))).when(inside & (p > 1 - low), -tail(F.sqrt(-2.0 * F.ln(1.0 - p)))).when(inside, middle)


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal, to double precision up to 7 deviations, by a continued fraction beyond."""
    z = F.abs(x)
    density = F.exp(-z * z / 2.0)
    near = density * _polynomial(WEST_TOP, z) / _polynomial(WEST_BOTTOM, z)
    deep = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        deep = z + F.lit(k) / deep
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(density / deep / 2.506628274631)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def log_normal_cdf(x: Column) -> Column:
    """Logarithm of the standard normal distribution function; far in the lower tail by its asymptotic series."""
    q = 1.0 / (x * x)
    far = -x * x / 2.0 - F.ln(-x) - math.log(math.sqrt(2 * math.pi)) + F.log1p(-q + 3.0 * q * q - 15.0 * q * q * q + 105.0 * q * q * q * q)
    return F.when(x < -12, far).otherwise(F.ln(normal_cdf(x)))


def expit(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), F.ln(p / (1.0 - p)))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def x_log_y(x: Column, y: Column) -> Column:
    """x ln y, 0 where x is 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through (xs, ys), constant outside; xs ascend."""
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(ys[-1]))


def unit_key(unit: Column) -> Column:
    """A unit's name without case, blanks, powers' signs and underscores."""
    return F.regexp_replace(F.replace(F.lower(F.trim(unit)), F.lit("°"), F.lit("deg")), r"\*\*|\^|\s|_", "")


def to_canonical(variable: str, value: Column, unit: Column) -> Column:
    """A value in the variable's canonical unit; an unknown unit raises."""
    out = None
    for names, (scale, offset) in UNITS[variable].items():
        hit = unit_key(unit).isin(*names.split())
        out = F.when(hit, value * scale + offset) if out is None else out.when(hit, value * scale + offset)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"unknown unit of {variable}: "), F.coalesce(unit, F.lit("none")))).cast("double"))


def to_latent(variable: str, x: Column) -> Column:
    """The scale on which a companion variable is modelled: logit of humidity, log of wind and radiation, which may not
    be negative."""
    if variable in ("HUMIN", "HUMAX"):
        p = clip(x / 100.0, 1e-4, 1 - 1e-4)
        return F.ln(p / (1.0 - p))
    if variable in ("WIND", "SOLAR"):
        return F.when(x < 0, F.raise_error(F.lit(f"{variable} is negative")).cast("double")).otherwise(F.log1p(x))
    return x


def from_latent(variable: str, z: Column) -> Column:
    if variable in ("HUMIN", "HUMAX"):
        return 100.0 / (1.0 + F.exp(-z))
    return F.expm1(clip(z, 0.0, 50.0)) if variable in ("WIND", "SOLAR") else z


def uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of the key's MD5, at midpoints.

    It doesn't depend on partitions, order or repetition of a task.
    """
    text = F.concat_ws("|", *[k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def wilson_bounds(count: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a share; null where there are no cases."""
    n, p = total.cast("double"), F.try_divide(count.cast("double"), total.cast("double"))
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    ok = total > 0
    return F.when(ok, F.greatest(F.lit(0.0), (middle - width) / scale)), F.when(ok, F.least(F.lit(1.0), (middle + width) / scale))


def brier(p: Column, outcome: Column) -> Column:
    return F.when((p >= 0) & (p <= 1), (p - outcome) * (p - outcome))


def harmonics(date: Column, k: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi * k) * F.dayofyear(date) / 365.25
    return F.sin(angle), F.cos(angle)
