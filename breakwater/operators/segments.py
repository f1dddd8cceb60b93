"""Statistics and costs of given segments: rows with a `segment_id` go through ordinary aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FLOOR = 1e-10


def theta(family: str, value: str, response: str | None = None) -> dict[str, Column]:
    """Aggregates with a segment's parameters."""
    x = F.col(value)
    if family == "mean":
        return {"mean": F.avg(x)}
    if family == "variance":
        return {"variance": F.var_samp(x)}
    if family == "meanvariance":
        return {"mean": F.avg(x), "variance": F.var_samp(x)}
    if family == "exponential":
        return {"rate": 1 / F.avg(x)}
    if family == "gaussian":
        return {"slope": F.sum(x * F.col(response)) / F.sum(x * x)}
    raise ValueError(f"family {family!r} has no closed form")


def cost(family: str, value: str, response: str | None = None, sigma2: float = 1.0) -> Column:
    """Aggregate with a segment's cost. For variance, `value` is centred already; for mean, in units of sigma2."""
    x, m = F.col(value), F.count(F.lit(1))
    if family == "mean":
        return (F.sum(x * x) - F.sum(x) * F.sum(x) / m) / (2 * sigma2)
    if family == "variance":
        return m / 2 * F.log(F.greatest(F.sum(x * x) / m, F.lit(_FLOOR)))
    if family == "meanvariance":
        v = F.var_pop(x)
        return m / 2 * F.log(F.when(v <= 0, F.lit(_FLOOR)).otherwise(v))
    if family == "exponential":
        return m * (F.log(F.avg(x)) + 1)
    if family == "gaussian":
        y = F.col(response)
        return (F.sum(y * y) - F.sum(x * y) * F.sum(x * y) / F.sum(x * x)) / 2
    raise ValueError(f"family {family!r} has no closed form")


def adjusted(c: Column, m: Column, adjustment: str, p: int) -> Column:
    if adjustment == "BIC":
        return c
    share = p * F.log(m) / 2
    return c + share if adjustment == "MBIC" else (c + share) * math.log2(math.e)


def residuals(df: DataFrame, keys: list[str], family: str, value: str, response: str | None = None) -> DataFrame:
    """Rows with `residual`; the segments' parameters come by a join on the keys, which are few."""
    stats = df.groupBy(*keys).agg(*(c.alias(f"__{n}") for n, c in theta(family, value, response).items()))
    x = F.col(value)
    what = {
        "mean": lambda: x - F.col("__mean"),
        "variance": lambda: x / F.sqrt(F.col("__variance")),
        "meanvariance": lambda: (x - F.col("__mean")) / F.sqrt(F.col("__variance")),
        "exponential": lambda: x * F.col("__rate") - 1,
        "gaussian": lambda: F.col(response) - x * F.col("__slope"),
    }[family]()
    joined = df.join(stats, keys)
    return joined.withColumn("residual", what).drop(*[c for c in joined.columns if c.startswith("__")])


def trim_filter(points: Column, n: Column | int, trim: float) -> Column:
    """Change points strictly inside (trim n, (1 - trim) n)."""
    return F.filter(points, lambda c: (c > trim * n) & (c < (1 - trim) * n))


def merge_close(points: Column, n: Column | int, trim: float) -> Column:
    """Change points at most trim n apart meet at the middle of their chain's ends; 0 is put first for this."""
    c = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), points)))
    size = F.size(c)
    gap = lambda i: F.get(c, i + 1) - F.get(c, i)
    every = F.sequence(F.lit(0), size - 1)
    # ends of chains face their starts
    right = F.transform(F.filter(every, lambda i: (i == size - 1) | (gap(i) > trim * n)), lambda i: F.get(c, i))
    left = F.transform(F.filter(every, lambda i: (i == 0) | (gap(i - 1) > trim * n)), lambda i: F.get(c, i))
    middle = F.zip_with(left, right, lambda a, b: F.floor((a + b) / 2).cast("long"))
    return F.filter(middle, lambda v: v > 0)
