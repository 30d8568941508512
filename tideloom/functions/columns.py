"""Column functions: name-addressed randomness, folds and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """A uniform draw in (0, 1) that depends on the named parts only: 52 bits of an md5."""
    name = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def normal(*parts: Column | str) -> Column:
    """A standard normal draw by Box-Muller from two named uniforms."""
    return F.sqrt(-2 * F.log(uniform(*parts, "r"))) * F.cos(2 * F.pi() * uniform(*parts, "a"))


def exponential(*parts: Column | str) -> Column:
    return -F.log(uniform(*parts))


def laplace(*parts: Column | str) -> Column:
    u = uniform(*parts) - 0.5
    return -F.signum(u) * F.log(1 - 2 * F.abs(u))


def stable(alpha: float, beta: float, *parts: Column | str) -> Column:
    """Alpha-stable draw (alpha not 1) by the trigonometric method on a uniform angle and an exponential."""
    import math

    angle, w = F.pi() * (uniform(*parts, "angle") - 0.5), exponential(*parts, "w")
    shift = math.atan(beta * math.tan(math.pi * alpha / 2)) / alpha
    size = (1 + (beta * math.tan(math.pi * alpha / 2)) ** 2) ** (1 / (2 * alpha))
    return size * F.sin(alpha * (angle + shift)) / F.pow(F.cos(angle), F.lit(1 / alpha)) * F.pow(F.cos(angle - alpha * (angle + shift)) / w, F.lit((1 - alpha) / alpha))


def stratified(rank: Column, n: int, u: Column, low: float, high: float, log: bool = False) -> Column:
    """A draw from stratum `rank` of n in [low, high]: one value in every stratum, on a log scale if asked."""
    at = (rank + u) / n
    if log:
        return F.exp(F.log(F.lit(low)) + at * (F.log(F.lit(high)) - F.log(F.lit(low))))
    return low + at * (high - low)


def significant(value: Column, digits: int = 4) -> Column:
    """A value at so many significant digits; null where it is not finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, F.format_string(f"%.{digits - 1}e", value).cast("double"))


def ar_fold(x: Column, phi: list[float]) -> Column:
    """Path of y[t] = x[t] + sum phi[k] y[t-k] from zero state, over an array (short series; longer ones in Arrow batches)."""
    zero = F.array().cast("array<double>")

    def step(path: Column, e: Column) -> Column:
        value = e
        for k, p in enumerate(phi, 1):
            value = value + p * F.coalesce(F.try_element_at(path, F.lit(-k)), F.lit(0.0))
        return F.concat(path, F.array(value))

    return F.aggregate(x, zero, step)


def ar1_last(x: Column, phi: float) -> Column:
    """Last value of the first-order recursion."""
    return F.aggregate(x, F.lit(0.0), lambda a, e: a * phi + e)


def garch_last(x: Column, omega: float, alpha: float, beta: float, start: float) -> Column:
    """Last conditional variance of h[t+1] = omega + alpha x[t]^2 + beta h[t]."""
    return F.aggregate(x, F.lit(start), lambda h, e: omega + alpha * e * e + beta * h)


def logistic_orbit(x0: Column, r: float, n: int) -> Column:
    """n points of x' = r x (1 - x) after x0."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(x0), lambda path, i: F.concat(path, F.array(r * F.element_at(path, -1) * (1 - F.element_at(path, -1)))))
