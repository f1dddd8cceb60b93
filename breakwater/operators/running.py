"""Running sums over the order: with them a segment's cost is a difference of two rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater import functions as X
from breakwater.operators import transforms
from breakwater.series import Series


def _sums(s: Series, columns: dict) -> DataFrame:
    return s.df.select(*s.partition_by, s.order_by, *(F.sum(c).over(s.running).alias(n) for n, c in columns.items()))


def mean(s: Series) -> DataFrame:
    """sum_<value> and sum_sq."""
    return _sums(s, {f"sum_{c}": F.col(c) for c in s.values} | {"sum_sq": sum((F.col(c) * F.col(c) for c in s.values), F.lit(0.0))})


def variance(s: Series) -> DataFrame:
    """Running products of centred values."""
    c = transforms.center(s)
    return _sums(c, {f"sum_{a}_{b}": F.col(a) * F.col(b) for a in s.values for b in s.values})


def meanvariance(s: Series) -> DataFrame:
    return _sums(s, {f"sum_{c}": F.col(c) for c in s.values} | {f"sum_{a}_{b}": F.col(a) * F.col(b) for a in s.values for b in s.values})


def exponential(s: Series) -> DataFrame:
    return _sums(s, {f"sum_{c}": F.col(c) for c in s.values})


def mgaussian(s: Series, responses: int = 1) -> DataFrame:
    """Running products of responses and predictors: yy, xy, xx."""
    y, x = s.values[:responses], s.values[responses:]
    pairs = [("yy", a, b) for a in y for b in y] + [("xy", a, b) for a in x for b in y] + [("xx", a, b) for a in x for b in x]
    return _sums(s, {f"{k}_{a}_{b}": F.col(a) * F.col(b) for k, a, b in pairs})


def log_factorials(s: Series) -> DataFrame:
    return _sums(s, {"sum_log_factorial": X.log_factorial(F.col(s.values[0]))})
