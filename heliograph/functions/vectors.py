"""Vector arithmetic as column expressions on ARRAY<FLOAT|DOUBLE>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def pairwise(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(_d(a), _d(b), f)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(pairwise(a, b, lambda x, y: x * y))


def norm(v: Column | str, p: float = 2.0) -> Column:
    return F.pow(total(F.transform(_d(v), lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p))


def distance(name: str, a: Column | str, b: Column | str, p: float = 3.0) -> Column:
    """A distance by name. As is customary here, euclidean, maximum and ell keep their squares,
    and histogram_intersection is a similarity; terms whose denominator or logarithm is undefined are 0."""
    diff = lambda f: pairwise(a, b, f)
    if name == "euclidean":
        return total(diff(lambda x, y: (x - y) * (x - y)))
    if name == "maximum":
        return F.array_max(diff(lambda x, y: (x - y) * (x - y)))
    if name == "manhattan":
        return total(diff(lambda x, y: F.abs(x - y)))
    if name == "ell":
        return F.pow(total(diff(lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(2.0 / p))
    if name == "cosine":
        return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))
    if name == "chisquare":
        return total(diff(lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), x + y), F.lit(0.0))))
    if name == "histogram_intersection":
        return total(diff(lambda x, y: F.least(x, y)))
    if name == "kullback":
        s = total(diff(lambda x, y: F.when((y > 0) & (x > 0), y * F.log(F.try_divide(y, x))).otherwise(0.0)))
        return s * s
    raise ValueError(f"no distance is named {name}")


def weighted_euclidean(a: Column | str, b: Column | str, w: Column | str) -> Column:
    """Squares of the differences, weighted by component."""
    return total(F.zip_with(pairwise(a, b, lambda x, y: (x - y) * (x - y)), _d(w), lambda x, y: x * y))


def mahalanobis(a: Column | str, b: Column | str, matrix: list[list[float]], bias: float = 0.0) -> Column:
    """d' M d for d = a - b, and a bias."""
    d = pairwise(a, b, lambda x, y: x - y)
    rows = F.array(*[dot(d, F.array(*[F.lit(float(x)) for x in r])) for r in matrix])
    return dot(d, rows) + bias


def divergence(p: Column | str, q: Column | str) -> Column:
    """The sum of p ln(p / q) over components where both are positive."""
    return total(pairwise(p, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.log(F.try_divide(x, y))).otherwise(0.0)))


def symmetric_kullback(a: Column | str, b: Column | str) -> Column:
    """The mean of the two squared divergences."""
    one, two = divergence(b, a), divergence(a, b)
    return (one * one + two * two) / 2


def normalise(v: Column | str, p: float = 2.0) -> Column:
    """v divided by its norm; a zero vector stays zero."""
    n = norm(v, p)
    return F.when(n > 0, F.transform(_d(v), lambda x: x / n)).otherwise(_d(v))


def signed_sqrt(v: Column | str) -> Column:
    return F.transform(_d(v), lambda x: F.signum(x) * F.sqrt(F.abs(x)))


def transpose(v: Column | str, rows: int, columns: int) -> Column:
    """The vector of a rows x columns matrix, read by columns."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.get(_d(v), (i % rows) * columns + F.floor(i / rows).cast("int")))


def moments(v: Column | str) -> Column:
    """mean, variance, skewness and excess kurtosis with the n-1 variance; 0 where that is 0."""
    v = _d(v)
    n = F.size(v).cast("double")
    mean = total(v) / n
    power = lambda k: total(F.transform(v, lambda x: F.pow(x - mean, F.lit(float(k)))))
    var = F.when(n > 1, power(2) / (n - 1)).otherwise(0.0)
    return F.struct(mean.alias("mean"), var.alias("variance"), F.when(var > 0, power(3) / n / F.pow(var, F.lit(1.5))).otherwise(0.0).alias("skewness"), F.when(var > 0, power(4) / n / (var * var) - 3).otherwise(0.0).alias("kurtosis"))


#: Weights of a separable kernel at the offsets 0, 1, .. radius.
def kernel(name: str, radius: int, parameter: float = 1.0) -> list[float]:
    import math

    at = range(radius + 1)
    if name == "point":
        return [1.0] + [0.0] * radius
    if name == "triangle":
        return [(radius + 1 - i) / (radius + 1) for i in at]
    if name == "rectangle":
        return [1.0] * (radius + 1)
    if name == "gaussian":
        return [math.exp(-((i * math.sqrt(math.log(2)) / parameter) ** 2)) for i in at]
    if name == "exponential":
        return [2 ** (-i / parameter) for i in at]
    if name == "hann":
        return [0.5 * (1 + math.cos(math.pi * i / (radius + 1))) for i in at]
    raise ValueError(f"no kernel is named {name}")
