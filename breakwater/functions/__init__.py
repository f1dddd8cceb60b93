"""Scalar functions of the cost families as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1pexp(v: Column) -> Column:
    """log(1 + exp(v)) without overflow."""
    return F.when(v > 0, v + F.log1p(F.exp(-v))).otherwise(F.log1p(F.exp(v)))


def logistic(v: Column) -> Column:
    return F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v)))


def soft_threshold(z: Column, t: Column | float) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - t, F.lit(0.0))


def logit(mu: Column) -> Column:
    return F.log(mu / (1 - mu))


def logit_inverse(eta: Column) -> Column:
    """Logistic, held within 30 of zero and away from 0 and 1."""
    tiny = 2.220446049250313e-16
    e = F.exp(F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0)))
    return F.greatest(F.least(e / (1 + e), F.lit(1 - tiny)), F.lit(tiny))


def variance_function(family: str, mu: Column) -> Column:
    return {"gaussian": F.lit(1.0), "binomial": mu * (1 - mu), "poisson": mu}[family]


def y_log_y(y: Column, mu: Column) -> Column:
    """y log(y / mu), 0 at y = 0."""
    return F.when(y == 0, F.lit(0.0)).otherwise(y * F.log(y / mu))


def unit_deviance(family: str, y: Column, mu: Column) -> Column:
    if family == "gaussian":
        return (y - mu) * (y - mu)
    if family == "binomial":
        return 2 * (y_log_y(y, mu) + y_log_y(1 - y, 1 - mu))
    return 2 * (y_log_y(y, mu) - (y - mu))


def pinball(r: Column, tau: float) -> Column:
    return F.when(r >= 0, tau * r).otherwise((tau - 1) * r)


def log_factorial(y: Column) -> Column:
    """log y! of whole numbers: an exact sum below 20, Stirling's series beyond (error under 1e-14)."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(y, F.lit(20)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    z = y + 1.0
    i = 1 / z
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + i / 12 - i * i * i / 360 + i * i * i * i * i / 1260 - i * i * i * i * i * i * i / 1680
    return F.when(y < 2, F.lit(0.0)).when(y <= 20, small).otherwise(series)
