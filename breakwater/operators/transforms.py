"""Row transforms of series (lags, differences, ranks, products, features); each returns a Series or a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakwater.series import Series


def lag_embed(s: Series, p: int) -> Series:
    """Each row with its p predecessors, the latest first (columns `<value>_lag<j>`); the first p rows go."""
    lags = [F.lag(c, j).over(s.window).alias(f"{c}_lag{j}") for j in range(1, p + 1) for c in s.values]
    names = [f"{c}_lag{j}" for j in range(1, p + 1) for c in s.values]
    df = s.df.select("*", *lags, F.row_number().over(s.window).alias("__row")).where(F.col("__row") > p).drop("__row")
    return s.with_df(df, [*s.values, *names])


def difference(s: Series, d: int = 1) -> Series:
    """Differences of order d: one window serves all orders, by binomial weights; the first d rows go."""
    def one(c: str) -> Column:
        out, weight = F.col(c), 1
        for j in range(1, d + 1):
            weight = -weight * (d - j + 1) // j
            out = out + weight * F.lag(c, j).over(s.window)
        return out

    df = s.df.select(*s.partition_by, s.order_by, *(one(c).alias(c) for c in s.values), F.row_number().over(s.window).alias("__row")).where(F.col("__row") > d).drop("__row")
    return s.with_df(df, s.values)


def centered_rank(s: Series) -> Series:
    """Ranks with ties averaged, less (n + 1) / 2.

    Values are counted first, so that the rank window sees each distinct value
    once, and ranks are joined back.
    """
    df = s.df
    for c in s.values:
        counts = df.groupBy(*s.partition_by, F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
        before = Window.partitionBy(*s.partition_by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.select(*(F.col(k).alias(f"__{k}") for k in s.partition_by), "__v", (F.sum("__k").over(before) - (F.col("__k") - 1) / 2 - (F.sum("__k").over(s.whole) + 1) / 2).alias("__r"))
        on = [F.col(c) == F.col("__v"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in s.partition_by)]
        df = df.join(ranked, on).drop("__v", *(f"__{k}" for k in s.partition_by)).withColumn(c, F.col("__r")).drop("__r")
    return s.with_df(df, s.values)


def center(s: Series) -> Series:
    return s.with_df(s.df.select(*s.partition_by, s.order_by, *((F.col(c) - F.avg(c).over(s.whole)).alias(c) for c in s.values)), s.values)


def whiten(s: Series, variance: Sequence[Sequence[float]]) -> Series:
    """Values times the Cholesky factor of the inverse covariance."""
    l = np.linalg.cholesky(np.linalg.inv(np.atleast_2d(np.asarray(variance, float))))
    cols = [sum((F.col(c) * float(l[i, j]) for i, c in enumerate(s.values) if l[i, j]), F.lit(0.0)).alias(s.values[j]) for j in range(len(s.values))]
    return s.with_df(s.df.select(*s.partition_by, s.order_by, *cols), s.values)


def outer_products(s: Series) -> Series:
    """Products of all pairs of values as `<a>_x_<b>`."""
    names = [(a, b) for a in s.values for b in s.values]
    return s.with_df(s.df.select(*s.partition_by, s.order_by, *((F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in names)), [f"{a}_x_{b}" for a, b in names])


def fourier_features(s: Series, omega: Sequence[Sequence[float]], phase: Sequence[float]) -> Series:
    """Random Fourier features `f0`, `f1`, ... with given weights."""
    scale = float(np.sqrt(2 / len(phase)))
    cols = [(scale * F.cos(sum((F.col(c) * float(omega[i][j]) for i, c in enumerate(s.values)), F.lit(float(phase[j]))))).alias(f"f{j}") for j in range(len(phase))]
    return s.with_df(s.df.select(*s.partition_by, s.order_by, *cols), [f"f{j}" for j in range(len(phase))])


def label_segments(s: Series, changes: Sequence[int]) -> DataFrame:
    """Rows with `row_index` (from 1) and `segment_id` (from 0), for change points that hold for every series."""
    row = F.row_number().over(s.window)
    segment = sum((F.when(F.col("row_index") > int(c), 1).otherwise(0) for c in changes), F.lit(0))
    return s.df.withColumn("row_index", row).withColumn("segment_id", segment)


def pad_residuals(residuals: DataFrame, s: Series) -> DataFrame:
    """All rows of the series with their residuals, null where there is none."""
    return s.df.select(*s.partition_by, s.order_by).join(residuals, [*s.partition_by, s.order_by], "left")
