"""Variance estimators as DataFrame aggregates; the general block estimator runs in the grouped kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakwater.kernels import prepare
from breakwater.operators import transforms
from breakwater.series import Series


def _grouped(s: Series, df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*s.partition_by).agg(*columns) if s.partition_by else df.agg(*columns)


def rice_covariance(s: Series) -> DataFrame:
    """Noise covariance from first differences, `cov_<a>_<b>`."""
    d = s.df.select(*s.partition_by, *((F.col(c) - F.lag(c, 1).over(s.window)).alias(c) for c in s.values))
    return _grouped(s, d, *((F.avg(F.col(a) * F.col(b)) / 2).alias(f"cov_{a}_{b}") for a in s.values for b in s.values))


def median_variance(s: Series) -> DataFrame:
    c = s.values[0]
    d = s.df.select(*s.partition_by, (F.col(c) - F.lag(c, 1).over(s.window)).alias("d"))
    m = 2 * F.avg(F.abs("d")) / 3
    return _grouped(s, d, (2 * m * m).alias("variance"))


def block_variance_one(s: Series) -> DataFrame:
    """Block regression variance of one response on one predictor, blocks of two rows, by windows alone."""
    y, x = s.values
    lead = lambda c, k: F.lead(c, k).over(s.window)
    rows = s.df.select(*s.partition_by, *(F.col(c).alias(c) if not k else lead(c, k).alias(f"{c}{k}") for k in range(3) for c in (y, x)))
    y0, x0, y1, x1, y2, x2 = (F.col(c) for c in (y, x, f"{y}1", f"{x}1", f"{y}2", f"{x}2"))
    ka, kb = 1 / (x0 * x0 + x1 * x1), 1 / (x1 * x1 + x2 * x2)
    d = (x0 * y0 + x1 * y1) * ka - (x1 * y1 + x2 * y2) * kb
    return _grouped(s, rows.where(F.col(f"{y}2").isNotNull()), F.avg(d * d / (ka + kb - 2 * ka * kb * x1 * x1)).alias("variance"))


def block_variance(s: Series, responses: int = 1, block: int | None = None, outlier_iqr: float = float("inf")) -> DataFrame:
    """Block regression variance in general, `variance` an array of responses * responses numbers."""
    values, order, keys = s.values, s.order_by, s.partition_by

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        z = frame.sort_values(order, kind="stable")[values].to_numpy(float)
        head = {k: [frame[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "variance": [prepare.block_variance(z, responses, block, outlier_iqr).ravel().tolist()]})

    kinds = dict(s.df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "variance array<double>"])
    return s.df.groupBy(*keys).applyInPandas(run, schema)


def arma_variance(s: Series, p: int, q: int, most: int | None = None) -> DataFrame:
    """sigma2, aic and bic of AR models of growing order, one row each."""
    values, order, keys = s.values, s.order_by, s.partition_by

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values(order, kind="stable")[values[0]].to_numpy(float)
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in keys}, **{("order" if k == "order" else k): v for k, v in prepare.arma_variance(x, p, q, most).items()}})[[*keys, "order", "sigma2", "aic", "bic"]]

    kinds = dict(s.df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "order long, sigma2 double, aic double, bic double"])
    return s.df.groupBy(*keys).applyInPandas(run, schema)


def arma_choice(table: DataFrame, keys: list[str], by: str = "bic") -> DataFrame:
    """keys, sigma2: of an `arma_variance` table the noise variance of the order with the least `by`, the first of equals."""
    least = F.min(F.struct(F.col(by), F.col("order"), F.col("sigma2"))).alias("least")
    return table.groupBy(*keys).agg(least).select(*keys, F.col("least.sigma2").alias("sigma2"))


def regression_rice(s: Series) -> DataFrame:
    """Half the mean squared difference of the residuals of a regression through the origin on one predictor."""
    y, x = s.values
    slope = F.sum(F.col(x) * F.col(y)).over(s.whole) / F.sum(F.col(x) * F.col(x)).over(s.whole)
    r = s.df.select(*s.partition_by, s.order_by, (F.col(y) - F.col(x) * slope).alias("r"))
    d = r.select(*s.partition_by, (F.col("r") - F.lag("r", 1).over(s.window)).alias("d"))
    return _grouped(s, d, (F.avg(F.col("d") * F.col("d")) / 2).alias("variance"))


def nearest_positive(m) -> np.ndarray:
    return prepare.nearest_positive(np.asarray(m, float))


def guarded(m) -> np.ndarray:
    return prepare.guarded(m)


def outlier_filter(df: DataFrame, column: str, k: float) -> DataFrame:
    """Rows below the third quartile plus k times the quartiles' distance (strictly)."""
    q = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    # one row, whatever the size of `df`
    return df.join(F.broadcast(q)).where(F.col(column) < F.get("__q", F.lit(1)) + k * (F.get("__q", F.lit(1)) - F.get("__q", F.lit(0)))).drop("__q")


__all__ = ["rice_covariance", "median_variance", "block_variance_one", "block_variance", "arma_variance", "regression_rice", "nearest_positive", "guarded", "outlier_filter", "transforms", "Window"]
