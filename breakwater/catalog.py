"""Queries by name over the test tables, and DuckDB SQL with the same rows.

Series come from `events` (by event_type, in the order of event_id; level or
scale shifts are put in by the order key) and from daily and monthly sums of
`orders` and `lineitem`. Doubles are rounded on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater import api, sql
from breakwater import functions as X
from breakwater import spec as specs
from breakwater.operators import estimators, running, segments, transforms
from breakwater.series import Series

LEVEL = "value + CASE WHEN event_id * 3 >= mx AND event_id * 3 < 2 * mx THEN 200 ELSE 0 END"
SCALE = "value * CASE WHEN event_id * 3 >= mx AND event_id * 3 < 2 * mx THEN 5 ELSE 1 END"
EVENTS = "SELECT event_type AS k, event_id AS i, {x} AS x FROM events, (SELECT max(event_id) AS mx FROM events) AS m"
DAILY = "SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, sum(o_totalprice) / 1000 AS x, CAST(count(*) AS DOUBLE) AS c FROM orders GROUP BY 1"
LINES = "SELECT CAST(CAST(l_shipdate AS DATE) AS STRING) AS d, avg(l_extendedprice) / 1000 AS y, avg(l_quantity) AS a, avg(l_discount) * 100 AS b, avg(l_tax) * 100 AS c FROM lineitem GROUP BY 1"
MONTHLY = "SELECT year(o_orderdate) * 12 + month(o_orderdate) AS d, avg(o_totalprice) / 1000 AS x, CAST(count(*) AS DOUBLE) AS c FROM orders GROUP BY 1"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if oracle is not None:
            _sql[f.__name__] = oracle
        return f

    return add


def select(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """SQL over the named tables, read for this statement."""
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def events(spark, sf_dir, x: str = LEVEL) -> DataFrame:
    return select(spark, sf_dir, EVENTS.format(x=x), "events")


def event_series(spark, sf_dir, x: str = LEVEL) -> Series:
    return Series.of(events(spark, sf_dir, x), "x", "i", "k")


def daily(spark, sf_dir) -> DataFrame:
    return select(spark, sf_dir, DAILY, "orders")


def lines(spark, sf_dir) -> DataFrame:
    return select(spark, sf_dir, LINES, "lineitem")


def monthly(spark, sf_dir) -> DataFrame:
    return select(spark, sf_dir, MONTHLY, "orders")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


E = f"WITH e AS ({EVENTS.format(x=LEVEL)})"


# estimators


@query(f"{E} SELECT k, round(avg(d * d) / 2, 6) AS cov_x_x FROM (SELECT k, x - lag(x) OVER (PARTITION BY k ORDER BY i) AS d FROM e) GROUP BY k")
def rice_variance(spark, sf_dir):
    return rounded(estimators.rice_covariance(event_series(spark, sf_dir)))


@query(f"{E} SELECT k, round(2 * (2 * avg(abs(d)) / 3) ** 2, 6) AS variance FROM (SELECT k, x - lag(x) OVER (PARTITION BY k ORDER BY i) AS d FROM e) GROUP BY k")
def median_variance(spark, sf_dir):
    return rounded(estimators.median_variance(event_series(spark, sf_dir)))


@query(f"WITH e AS ({DAILY}), f AS (SELECT x - lag(x) OVER (ORDER BY d) AS u, c - lag(c) OVER (ORDER BY d) AS v FROM e) SELECT round(avg(u * u) / 2, 6) AS cov_x_x, round(avg(u * v) / 2, 6) AS cov_x_c, round(avg(v * u) / 2, 6) AS cov_c_x, round(avg(v * v) / 2, 6) AS cov_c_c FROM f")
def rice_covariance_2d(spark, sf_dir):
    return rounded(estimators.rice_covariance(Series.of(daily(spark, sf_dir), ["x", "c"], "d")))


_BLOCK = f"WITH e AS ({LINES}), f AS (SELECT y AS y0, a AS x0, lead(y, 1) OVER (ORDER BY d) AS y1, lead(a, 1) OVER (ORDER BY d) AS x1, lead(y, 2) OVER (ORDER BY d) AS y2, lead(a, 2) OVER (ORDER BY d) AS x2 FROM e), g AS (SELECT *, 1 / (x0 * x0 + x1 * x1) AS p, 1 / (x1 * x1 + x2 * x2) AS q FROM f WHERE y2 IS NOT NULL)"


@query(f"{_BLOCK} SELECT round(avg(((x0 * y0 + x1 * y1) * p - (x1 * y1 + x2 * y2) * q) ** 2 / (p + q - 2 * p * q * x1 * x1)), 6) AS variance FROM g")
def block_variance_lm_p1(spark, sf_dir):
    return rounded(estimators.block_variance_one(Series.of(lines(spark, sf_dir), ["y", "a"], "d")))


@query(f"{_BLOCK} SELECT round(avg(((x0 * y0 + x1 * y1) * p - (x1 * y1 + x2 * y2) * q) ** 2 / (p + q - 2 * p * q * x1 * x1)), 6) AS variance FROM g")
def block_variance_kernel(spark, sf_dir):
    out = estimators.block_variance(Series.of(lines(spark, sf_dir), ["y", "a"], "d"))
    return rounded(out.select(F.get("variance", F.lit(0)).alias("variance")))


@query()
def variance_arma(spark, sf_dir):
    return rounded(estimators.arma_variance(Series.of(daily(spark, sf_dir), "x", "d"), 3, 2), 3)


#: The closed form of `block_variance_lm_p1` for one lag.
_AR_VARIANCE = (
    f"WITH e AS (SELECT d AS i, x AS y, lag(x) OVER (ORDER BY d) AS a FROM ({DAILY})), f AS (SELECT y AS y0, a AS x0, lead(y, 1) OVER w AS y1, lead(a, 1) OVER w AS x1, lead(y, 2) OVER w AS y2, lead(a, 2) OVER w AS x2 FROM e WHERE a IS NOT NULL WINDOW w AS (ORDER BY i)), g AS (SELECT *, 1 / (x0 * x0 + x1 * x1) AS p, 1 / (x1 * x1 + x2 * x2) AS q FROM f WHERE y2 IS NOT NULL), v AS (SELECT avg(((x0 * y0 + x1 * y1) * p - (x1 * y1 + x2 * y2) * q) ** 2 / (p + q - 2 * p * q * x1 * x1)) AS s FROM g), n AS (SELECT count(*) AS n FROM ({DAILY}))"
)


@query(f'{_AR_VARIANCE} SELECT CAST(1 AS BIGINT) AS "order", round(s, 4) AS sigma2, round(ln(s) + 2.0 / n, 8) AS aic, round(ln(s) + ln(n) / n, 8) AS bic FROM v, n')
def variance_ar_one_lag(spark, sf_dir):
    table = estimators.arma_variance(Series.of(daily(spark, sf_dir), "x", "d"), 1, 1)
    return table.select("order", F.round("sigma2", 4).alias("sigma2"), F.round("aic", 8).alias("aic"), F.round("bic", 8).alias("bic"))


@query(f"{_AR_VARIANCE} SELECT round(s, 4) AS sigma2 FROM v")
def variance_ar_choice(spark, sf_dir):
    return rounded(estimators.arma_choice(estimators.arma_variance(Series.of(daily(spark, sf_dir), "x", "d"), 1, 1), []), 4)


@query(f"WITH e AS ({LINES}), b AS (SELECT sum(a * y) / sum(a * a) AS s FROM e), r AS (SELECT d, y - a * s AS r FROM e, b), f AS (SELECT r - lag(r) OVER (ORDER BY d) AS u FROM r) SELECT round(avg(u * u) / 2, 6) AS variance FROM f")
def regression_rice(spark, sf_dir):
    return rounded(estimators.regression_rice(Series.of(lines(spark, sf_dir), ["y", "a"], "d")))


@query(f"WITH e AS ({DAILY}), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM e) SELECT d, round(x, 6) AS x FROM e, q WHERE x < b + 0.5 * (b - a)")
def outlier_filter(spark, sf_dir):
    return rounded(estimators.outlier_filter(daily(spark, sf_dir).select("d", "x"), "x", 0.5))


# transforms


@query(f"{E}, f AS (SELECT k, i, x, lag(x, 1) OVER w AS x_lag1, lag(x, 2) OVER w AS x_lag2, lag(x, 3) OVER w AS x_lag3, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY k ORDER BY i)) SELECT k, i, round(x, 6) AS x, round(x_lag1, 6) AS x_lag1, round(x_lag2, 6) AS x_lag2, round(x_lag3, 6) AS x_lag3 FROM f WHERE r > 3")
def ar_lag_embed(spark, sf_dir):
    return rounded(transforms.lag_embed(event_series(spark, sf_dir), 3).df)


@query(f"WITH e AS ({DAILY}), f AS (SELECT d, x, c, lag(x, 1) OVER w AS x_lag1, lag(c, 1) OVER w AS c_lag1, lag(x, 2) OVER w AS x_lag2, lag(c, 2) OVER w AS c_lag2, row_number() OVER w AS r FROM e WINDOW w AS (ORDER BY d)) SELECT d, round(x, 5) AS x, c, round(x_lag1, 5) AS x_lag1, c_lag1, round(x_lag2, 5) AS x_lag2, c_lag2 FROM f WHERE r > 2")
def var_lag_embed(spark, sf_dir):
    return rounded(transforms.lag_embed(Series.of(daily(spark, sf_dir), ["x", "c"], "d"), 2).df, 5)


@query(f"{E}, f AS (SELECT k, i, x - 2 * lag(x, 1) OVER w + lag(x, 2) OVER w AS x, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY k ORDER BY i)) SELECT k, i, round(x, 6) AS x FROM f WHERE r > 2")
def difference(spark, sf_dir):
    return rounded(transforms.difference(event_series(spark, sf_dir), 2).df)


@query(f"WITH e AS (SELECT event_type AS k, event_id AS i, round(value, 0) AS x FROM events) SELECT k, i, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 - (count(*) OVER (PARTITION BY k) + 1) / 2.0 AS x FROM e")
def centered_rank(spark, sf_dir):
    df = select(spark, sf_dir, "SELECT event_type AS k, event_id AS i, round(value, 0) AS x FROM events", "events")
    return transforms.centered_rank(Series.of(df, "x", "i", "k")).df.select("k", "i", "x")


@query(f"{E} SELECT k, i, round(x - avg(x) OVER (PARTITION BY k), 6) AS x FROM e")
def center(spark, sf_dir):
    return rounded(transforms.center(event_series(spark, sf_dir)).df)


@query(f"{E} SELECT k, i, round(x / 2.0, 6) AS x FROM e")
def whiten(spark, sf_dir):
    return rounded(transforms.whiten(event_series(spark, sf_dir), [[4.0]]).df)


@query(f"WITH e AS ({DAILY}) SELECT d, round(x * x, 5) AS x_x_x, round(x * c, 5) AS x_x_c, round(c * x, 5) AS c_x_x, round(c * c, 5) AS c_x_c FROM e")
def outer_products(spark, sf_dir):
    return rounded(transforms.outer_products(Series.of(daily(spark, sf_dir), ["x", "c"], "d")).df, 5)


@query(f"{E} SELECT k, i, round(sqrt(2 / 2.0) * cos(0.25 * x + 0.5), 6) AS f0, round(sqrt(2 / 2.0) * cos(-0.125 * x + 1.5), 6) AS f1 FROM e")
def fourier_features(spark, sf_dir):
    return rounded(transforms.fourier_features(event_series(spark, sf_dir), [[0.25, -0.125]], [0.5, 1.5]).df)


@query(f"{E}, r AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) AS row_index FROM e) SELECT k, i, CAST(row_index AS INTEGER) AS row_index, CAST(CASE WHEN row_index > 120 THEN 2 WHEN row_index > 50 THEN 1 ELSE 0 END AS INTEGER) AS segment_id FROM r")
def label_segments(spark, sf_dir):
    return transforms.label_segments(event_series(spark, sf_dir), [50, 120]).select("k", "i", "row_index", "segment_id")


# running sums

_W = "(PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)"


@query(f"{E} SELECT k, i, round(sum(x) OVER {_W}, 5) AS sum_x, round(sum(x * x) OVER {_W}, 5) AS sum_sq FROM e")
def prefix_mean(spark, sf_dir):
    return running.mean(event_series(spark, sf_dir)).select("k", "i", F.round("sum_x", 5).alias("sum_x"), F.round("sum_sq", 5).alias("sum_sq"))


@query(f"{E}, c AS (SELECT k, i, x - avg(x) OVER (PARTITION BY k) AS x FROM e) SELECT k, i, round(sum(x * x) OVER {_W}, 2) AS sum_x_x FROM c")
def prefix_variance(spark, sf_dir):
    return rounded(running.variance(event_series(spark, sf_dir)), 2)


@query(f"{E} SELECT k, i, round(sum(x) OVER {_W}, 5) AS sum_x, round(sum(x * x) OVER {_W}, 5) AS sum_x_x FROM e")
def prefix_meanvariance(spark, sf_dir):
    return rounded(running.meanvariance(event_series(spark, sf_dir)), 5)


@query(f"{E} SELECT k, i, round(sum(x) OVER {_W}, 5) AS sum_x FROM e")
def prefix_exponential(spark, sf_dir):
    return rounded(running.exponential(event_series(spark, sf_dir)), 5)


@query(f"WITH e AS ({LINES}) SELECT d, round(sum(y * y) OVER w, 2) AS yy_y_y, round(sum(a * y) OVER w, 2) AS xy_a_y, round(sum(a * a) OVER w, 2) AS xx_a_a FROM e WINDOW w AS (ORDER BY d ROWS UNBOUNDED PRECEDING)")
def prefix_mgaussian(spark, sf_dir):
    return rounded(running.mgaussian(Series.of(lines(spark, sf_dir), ["y", "a"], "d")), 2)


@query(f"WITH e AS (SELECT d, c FROM ({DAILY})) SELECT d, round(sum(lgamma(c + 1)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 5) AS sum_log_factorial FROM e")
def prefix_log_factorial(spark, sf_dir):
    return rounded(running.log_factorials(Series.of(daily(spark, sf_dir), "c", "d")), 5)


# given segments


def segmented(spark, sf_dir, x: str = SCALE) -> DataFrame:
    s = event_series(spark, sf_dir, x)
    return s.df.withColumn("segment_id", F.ntile(4).over(s.window))


_SEG = f"WITH e AS ({EVENTS.format(x=SCALE)}), s AS (SELECT k, i, x, ntile(4) OVER (PARTITION BY k ORDER BY i) AS segment_id FROM e)"
_CENTRED = f"{_SEG}, z AS (SELECT k, segment_id, x - avg(x) OVER (PARTITION BY k) AS x FROM s)"


@query(f"{_SEG} SELECT k, CAST(segment_id AS INTEGER) AS segment_id, round((sum(x * x) - sum(x) * sum(x) / count(*)) / 2, 2) AS cost FROM s GROUP BY k, segment_id")
def segment_cost_mean(spark, sf_dir):
    return rounded(segmented(spark, sf_dir).groupBy("k", "segment_id").agg(segments.cost("mean", "x").alias("cost")), 2)


@query(f"{_CENTRED} SELECT k, CAST(segment_id AS INTEGER) AS segment_id, round(count(*) / 2.0 * ln(sum(x * x) / count(*)), 3) AS cost FROM z GROUP BY k, segment_id")
def segment_cost_variance(spark, sf_dir):
    df = segmented(spark, sf_dir)
    from pyspark.sql import Window

    df = df.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("k")))
    return rounded(df.groupBy("k", "segment_id").agg(segments.cost("variance", "x").alias("cost")), 3)


@query(f"{_SEG} SELECT k, CAST(segment_id AS INTEGER) AS segment_id, round(count(*) / 2.0 * ln(var_pop(x)), 3) AS cost FROM s GROUP BY k, segment_id")
def segment_cost_meanvariance(spark, sf_dir):
    return rounded(segmented(spark, sf_dir).groupBy("k", "segment_id").agg(segments.cost("meanvariance", "x").alias("cost")), 3)


@query(f"{_SEG} SELECT k, CAST(segment_id AS INTEGER) AS segment_id, round(count(*) * (ln(avg(x)) + 1), 3) AS cost FROM s GROUP BY k, segment_id")
def segment_cost_exponential(spark, sf_dir):
    return rounded(segmented(spark, sf_dir).groupBy("k", "segment_id").agg(segments.cost("exponential", "x").alias("cost")), 3)


_LSEG = f"WITH e AS ({LINES}), s AS (SELECT d, y, a, ntile(4) OVER (ORDER BY d) AS segment_id FROM e)"


def line_segments(spark, sf_dir) -> DataFrame:
    s = Series.of(lines(spark, sf_dir), ["y", "a"], "d")
    return s.df.withColumn("segment_id", F.ntile(4).over(s.window))


@query(f"{_LSEG} SELECT CAST(segment_id AS INTEGER) AS segment_id, round((sum(y * y) - sum(a * y) * sum(a * y) / sum(a * a)) / 2, 2) AS cost FROM s GROUP BY segment_id")
def segment_cost_gaussian_p1(spark, sf_dir):
    return rounded(line_segments(spark, sf_dir).groupBy("segment_id").agg(segments.cost("gaussian", "a", "y").alias("cost")), 2)


@query(f"{_LSEG} SELECT CAST(segment_id AS INTEGER) AS segment_id, round(sum(a * y) / sum(a * a), 5) AS slope FROM s GROUP BY segment_id")
def segment_theta_gaussian(spark, sf_dir):
    return rounded(line_segments(spark, sf_dir).groupBy("segment_id").agg(*(c.alias(n) for n, c in segments.theta("gaussian", "a", "y").items())), 5)


def _theta(family: str):
    def f(spark, sf_dir):
        return rounded(segmented(spark, sf_dir).groupBy("k", "segment_id").agg(*(c.alias(n) for n, c in segments.theta(family, "x").items())))

    f.__name__ = f"segment_theta_{family}"
    return f


for _name, _what in {"mean": "round(avg(x), 6) AS mean", "variance": "round(var_samp(x), 6) AS variance", "meanvariance": "round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance", "exponential": "round(1 / avg(x), 6) AS rate"}.items():
    query(f"{_SEG} SELECT k, CAST(segment_id AS INTEGER) AS segment_id, {_what} FROM s GROUP BY k, segment_id")(_theta(_name))


def _residuals(family: str):
    def f(spark, sf_dir):
        return rounded(segments.residuals(segmented(spark, sf_dir), ["k", "segment_id"], family, "x").select("k", "i", "residual"))

    f.__name__ = f"segment_residuals_{family}"
    return f


for _name, _what in {"mean": "x - avg(x) OVER w", "variance": "x / sqrt(var_samp(x) OVER w)", "meanvariance": "(x - avg(x) OVER w) / sqrt(var_samp(x) OVER w)", "exponential": "x / avg(x) OVER w - 1"}.items():
    query(f"{_SEG} SELECT k, i, round({_what}, 6) AS residual FROM s WINDOW w AS (PARTITION BY k, segment_id)")(_residuals(_name))


@query(f"WITH e AS ({LINES}), r AS (SELECT y, a, row_number() OVER (ORDER BY d) - 1 AS p, count(*) OVER () AS n FROM e), q AS (SELECT y, a, CAST(b AS INTEGER) AS block_id FROM r, (SELECT unnest(range(0, 10)) AS b) WHERE p >= round_even(b * n / 10.0, 0) AND p < round_even((b + 1) * n / 10.0, 0)) SELECT block_id, count(*) AS n_rows, round(sum(a * y) / sum(a * a), 5) AS slope FROM q GROUP BY block_id")
def block_statistics(spark, sf_dir):
    s = Series.of(lines(spark, sf_dir), ["y", "a"], "d")
    n = F.count(F.lit(1)).over(s.whole)
    df = s.df.withColumn("p", F.row_number().over(s.window) - 1).withColumn("n", n)
    block = sum((F.when(F.col("p") >= F.bround(F.lit(float(b)) * F.col("n") / 10.0), 1).otherwise(0) for b in range(1, 10)), F.lit(0))
    out = df.withColumn("block_id", block).groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"), *(c.alias(k) for k, c in segments.theta("gaussian", "a", "y").items()))
    return rounded(out, 5)


# penalties, scalar functions, post-processing


@query("SELECT family, p, n, round((p + 1) * ln(n) / 2, 6) AS bic, round((p + 2) * ln(n) / 2, 6) AS mbic, round((p + 2) * log2(n) / 2, 6) AS mdl, CASE WHEN family = 'garch' THEN NULL ELSE round(p * ln(2), 6) END AS pruning_mbic FROM (VALUES ('mean', 1, 1000), ('variance', 1, 1000), ('meanvariance', 2, 1000), ('exponential', 1, 1000), ('garch', 3, 120), ('gaussian', 4, 300)) AS v(family, p, n)")
def penalty_table(spark, sf_dir):
    rows = []
    for family, d, order, n in (("mean", 1, None, 1000), ("variance", 1, None, 1000), ("meanvariance", 1, None, 1000), ("exponential", 1, None, 1000), ("garch", 1, (1, 1), 120), ("gaussian", 5, None, 300)):
        p = specs.parameter_count(specs.make(family, order), d)
        constant = specs.pruning_constant(specs.make(family, order), p)
        # families that keep all candidates have no constant
        rows.append((family, p, n, *(round(specs.penalty(b, p, n), 6) for b in ("BIC", "MBIC", "MDL")), round(constant, 6) if math.isfinite(constant) else None))
    return spark.createDataFrame(rows, "family string, p int, n int, bic double, mbic double, mdl double, pruning_mbic double")


@query("WITH e AS (SELECT event_id AS i, (value - 50) / 10 AS v FROM events) SELECT i, round(CASE WHEN v > 0 THEN v + ln(1 + exp(-v)) ELSE ln(1 + exp(v)) END, 6) AS log1pexp, round(1 / (1 + exp(-v)), 6) AS logistic, round(sign(v) * greatest(abs(v) - 1, 0) + 0.0, 6) + 0.0 AS soft, round(CASE WHEN v >= 0 THEN 0.3 * v ELSE -0.7 * v END, 6) AS pinball, round(CASE WHEN round(abs(v)) = 0 THEN 0 ELSE round(abs(v)) * ln(round(abs(v)) / 2) END, 6) AS ylogy, round(lgamma(round(abs(v) * 10) + 1), 6) AS log_factorial FROM e")
def scalar_functions(spark, sf_dir):
    df = select(spark, sf_dir, "SELECT event_id AS i, (value - 50) / 10 AS v FROM events", "events")
    v = F.col("v")
    return df.select("i", *(F.round(c, 6).alias(n) for n, c in {"log1pexp": X.log1pexp(v), "logistic": X.logistic(v), "soft": X.soft_threshold(v, 1.0), "pinball": X.pinball(v, 0.3), "ylogy": X.y_log_y(F.round(F.abs(v)), F.lit(2.0)), "log_factorial": X.log_factorial(F.round(F.abs(v) * 10))}.items()))


_POINTS = "SELECT c_nationkey AS g, list_sort(list_distinct(list(CAST(c_custkey * 7919 % 997 + 2 AS BIGINT)))) AS points FROM customer GROUP BY 1"


def points(spark, sf_dir) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.groupBy(F.col("c_nationkey").alias("g")).agg(F.array_sort(F.collect_set((F.col("c_custkey") * 7919 % 997 + 2).cast("long"))).alias("points"))


@query(f"SELECT g, unnest(list_filter(points, lambda c: c > 0.05 * 1000 AND c < 0.95 * 1000)) AS c FROM ({_POINTS})")
def trim_filter(spark, sf_dir):
    return points(spark, sf_dir).select("g", F.explode(segments.trim_filter(F.col("points"), F.lit(1000), 0.05)).alias("c"))


@query(
    f"""WITH v AS (SELECT g, [0::BIGINT] || points AS k FROM ({_POINTS})),
i AS (SELECT g, k, list_filter(range(1, len(k)), lambda i: k[i + 1] - k[i] <= 20) AS c FROM v),
z AS (SELECT g, k, list_filter(range(1, len(k) + 1), lambda i: NOT list_contains(c, i)) AS a, list_filter(range(1, len(k) + 1), lambda i: NOT list_contains(c, i - 1)) AS b FROM i),
m AS (SELECT g, unnest(list_transform(range(1, len(a) + 1), lambda i: (k[a[i]] + k[b[i]]) // 2)) AS c FROM z)
SELECT g, c FROM m WHERE c > 0"""
)
def merge_close(spark, sf_dir):
    return points(spark, sf_dir).select("g", F.explode(segments.merge_close(F.col("points"), F.lit(1000), 0.02)).alias("c"))


@query(
    "WITH e AS (SELECT event_id AS i, value, 0.01 + 0.98 * (event_id % 97) / 97.0::DOUBLE AS mu, event_id % 2 AS y FROM events) SELECT i, round(ln(mu / (1 - mu)), 6) AS logit, round(1 / (1 + exp(-greatest(least(value - 50, 30), -30))), 8) AS inverse, round(mu * (1 - mu), 6) AS binomial_variance, round((value - mu) ** 2, 5) AS gaussian_deviance, round(-2 * ln(CASE WHEN y = 1 THEN mu ELSE 1 - mu END), 6) AS binomial_deviance, round(2 * (CASE WHEN round(abs(value)) = 0 THEN 0 ELSE round(abs(value)) * ln(round(abs(value)) / mu) END - (round(abs(value)) - mu)), 5) AS poisson_deviance FROM e"
)
def link_functions(spark, sf_dir):
    df = select(spark, sf_dir, "SELECT event_id AS i, value, 0.01D + 0.98D * (event_id % 97) / 97.0D AS mu, event_id % 2 AS y FROM events", "events")
    mu, value, y, count = F.col("mu"), F.col("value"), F.col("y").cast("double"), F.round(F.abs("value"))
    return df.select(
        "i",
        F.round(X.logit(mu), 6).alias("logit"),
        F.round(X.logit_inverse(value - 50), 8).alias("inverse"),
        F.round(X.variance_function("binomial", mu), 6).alias("binomial_variance"),
        F.round(X.unit_deviance("gaussian", value, mu), 5).alias("gaussian_deviance"),
        F.round(X.unit_deviance("binomial", y, mu), 6).alias("binomial_deviance"),
        F.round(X.unit_deviance("poisson", count, mu), 5).alias("poisson_deviance"),
    )


@query(f"WITH e AS ({DAILY}), r AS (SELECT d, x, row_number() OVER (ORDER BY d) AS i FROM e) SELECT d, CASE WHEN i > 2 THEN round(x, 5) END AS residual FROM r")
def residual_padding(spark, sf_dir):
    s = Series.of(daily(spark, sf_dir), "x", "d")
    lagged = transforms.lag_embed(s, 2).df.select("d", F.col("x").alias("residual"))
    return rounded(transforms.pad_residuals(lagged, s), 5)


# segmentation

_BIC = {"beta": "BIC", "cost_adjustment": "BIC", "pruning": 0.0}


def optimal(series: str, cost: str, p: int, scale: str = "1.0", sums: dict[str, str] | None = None, penalty: str | None = None) -> str:
    """Optimal partitioning by a recursive query: start and end of each segment of each series k, ordered by i.

    `sums` are running sums by name, kept as lists from 0 on; `cost` is in
    terms of their differences, of m (the length) and v (the scale).
    """
    sums = sums or {"s": "x", "q": "x * x"}
    lists = ", ".join(f"[0.0::DOUBLE] || list({n} ORDER BY r) AS {n}" for n in sums)
    windows = ", ".join(f"sum({e}) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS {n}" for n, e in sums.items())
    for n in sums:
        cost = cost.replace(f"<{n}>", f"(p.{n}[d.t + 2] - p.{n}[j + 1])")
    cost = cost.replace("<m>", "(d.t + 1 - j)").replace("<v>", "p.v")
    beta = penalty or f"{p + 1} * ln(n) / 2"
    return f"""
WITH RECURSIVE e AS ({series}),
w AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS r, {windows} FROM e),
v AS (SELECT k, {scale} AS v FROM e GROUP BY k),
p AS (SELECT k, v, n, {beta} AS beta, {', '.join(sums)} FROM (SELECT k, count(*) AS n, {lists} FROM w GROUP BY k) JOIN v USING (k)),
dp AS (
  SELECT k, 0 AS t, [-beta] AS f, [0] AS b FROM p
  UNION ALL
  SELECT k, t + 1, list_append(f, list_min(c)), list_append(b, CAST(list_position(c, list_min(c)) - 1 AS INTEGER))
  FROM (SELECT d.k, d.t, d.f, d.b, list_transform(range(0, d.t + 1), lambda j: d.f[j + 1] + {cost} + p.beta) AS c FROM dp d JOIN p ON d.k = p.k WHERE d.t < p.n)),
z AS (SELECT dp.k, dp.t, dp.b FROM dp JOIN p ON dp.k = p.k AND dp.t = p.n),
back AS (SELECT k, CAST(t AS BIGINT) AS e FROM z UNION ALL SELECT back.k, CAST(z.b[back.e + 1] AS BIGINT) FROM back JOIN z ON back.k = z.k WHERE z.b[back.e + 1] > 0)
SELECT k, lag(e, 1, 0) OVER (PARTITION BY k ORDER BY e) + 1 AS start_index, e AS end_index FROM back
"""


def _segments(result: api.Detection) -> DataFrame:
    return result.segments.select(*result.series.partition_by, "start_index", "end_index")


_RICE = "(SELECT avg(d * d) / 2 FROM (SELECT x - lag(x) OVER (ORDER BY i) AS d FROM e AS e2 WHERE e2.k = e.k))"
_BYKEY = "any_value((SELECT avg(d * d) / 2 FROM (SELECT u.k AS k, u.x - lag(u.x) OVER (PARTITION BY u.k ORDER BY u.i) AS d FROM e AS u) AS g WHERE g.k = e.k))"
_MEAN = "(<q> - <s> * <s> / <m>) / 2 / <v>"


@query(optimal(EVENTS.format(x=LEVEL), _MEAN, 1, _BYKEY))
def cp_mean_grouped(spark, sf_dir):
    return _segments(api.mean(events(spark, sf_dir), "x", "i", "k", keep=False, **_BIC))


@query(optimal("SELECT 1 AS k, d AS i, x + CASE WHEN d >= '1995-01-01' THEN 3000 ELSE 0 END AS x FROM (SELECT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS STRING) AS d, sum(o_totalprice) / 1000 AS x FROM orders GROUP BY 1)", _MEAN, 1, _BYKEY).replace("SELECT k, lag(e", "SELECT lag(e"))
def cp_mean(spark, sf_dir):
    df = select(spark, sf_dir, "SELECT d, x + CASE WHEN d >= '1995-01-01' THEN 3000 ELSE 0 END AS x FROM (SELECT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS STRING) AS d, sum(o_totalprice) / 1000 AS x FROM orders GROUP BY 1)", "orders")
    return _segments(api.mean(df, "x", "d", keep=False, **_BIC))


@query(optimal(EVENTS.format(x=LEVEL), _MEAN + " + ln(<m>) / 2", 1, _BYKEY, penalty="3 * ln(n) / 2"))
def cp_mean_mbic_exact(spark, sf_dir):
    return _segments(api.mean(events(spark, sf_dir), "x", "i", "k", keep=False, pruning="exact"))


_CENTER = f"SELECT k, i, x - avg(x) OVER (PARTITION BY k) AS x FROM ({EVENTS.format(x=SCALE)})"


@query(optimal(_CENTER, "<m> / 2.0 * ln(greatest(<q> / <m>, 1e-10))", 1))
def cp_variance(spark, sf_dir):
    return _segments(api.variance(events(spark, sf_dir, SCALE), "x", "i", "k", keep=False, **_BIC))


@query(optimal(_CENTER, "<m> / 2.0 * ln(CASE WHEN <q> / <m> - (<s> / <m>) ** 2 <= 0 OR <m> = 1 THEN 1e-10 ELSE <q> / <m> - (<s> / <m>) ** 2 END)", 2, penalty="200.0::DOUBLE"))
def cp_meanvariance(spark, sf_dir):
    return _segments(api.meanvariance(events(spark, sf_dir, SCALE), "x", "i", "k", keep=False, beta=200.0, cost_adjustment="BIC", pruning=0.0))


@query(optimal(EVENTS.format(x=SCALE), "<m> * (ln(<s> / <m>) + 1)", 1))
def cp_exponential(spark, sf_dir):
    return _segments(api.exponential(events(spark, sf_dir, SCALE), "x", "i", "k", keep=False, **_BIC))


_RANKS = f"SELECT k, i, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 - (count(*) OVER (PARTITION BY k) + 1) / 2.0 AS x FROM ({EVENTS.format(x=LEVEL)})"


@query(optimal(_RANKS, _MEAN, 1, _BYKEY))
def cp_rank(spark, sf_dir):
    return _segments(api.rank(events(spark, sf_dir), "x", "i", "k", keep=False, **_BIC))


@query(optimal("SELECT 1 AS k, d AS i, x FROM (" + MONTHLY + ")", "(<q> - <s> * <s> / <m>) / 2", 1, penalty="50.0::DOUBLE").replace("SELECT k, lag(e", "SELECT lag(e"))
def cp_custom_l2(spark, sf_dir):
    return _segments(api.custom(monthly(spark, sf_dir), "x", "d", keep=False, cost=lambda z: ((z - z.mean()) ** 2).sum() / 2, parameters=1, beta=50.0, cost_adjustment="BIC", pruning=0.0))


_SWITCH = "SELECT d, y * CASE WHEN d >= '1995-06-01' THEN 2 ELSE 1 END AS y, a, b, c FROM ({x})"


def switched(spark, sf_dir) -> DataFrame:
    return select(spark, sf_dir, _SWITCH.format(x=LINES), "lineitem")


@query(optimal("SELECT 1 AS k, d AS i, y, a FROM (" + _SWITCH.format(x=LINES) + ")", "(<yy> - <ay> * <ay> / <aa>) / 2", 1, sums={"yy": "y * y", "ay": "a * y", "aa": "a * a"}, penalty="5000.0::DOUBLE").replace("SELECT k, lag(e", "SELECT lag(e"))
def cp_lm_p1_vanilla(spark, sf_dir):
    return _segments(api.lm(switched(spark, sf_dir), ["y", "a"], "d", keep=False, vanilla=1.0, beta=5000.0, cost_adjustment="BIC", pruning=0.0))


def _one(series: str, cost: str, sums: dict[str, str], penalty: float) -> str:
    """`optimal` for one series."""
    return optimal(f"SELECT 1 AS k, * FROM ({series})", cost, 1, sums=sums, penalty=f"{penalty}::DOUBLE").replace("SELECT k, lag(e", "SELECT lag(e")


def _exact(name: str, sql_text: str, f: Callable[[SparkSession, str], api.Detection]) -> None:
    """Segment bounds of a segmentation, with SQL."""

    def run(spark, sf_dir):
        return _segments(f(spark, sf_dir))

    run.__name__ = name
    query(sql_text)(run)


def _plain(beta: float, **more) -> dict:
    return {"keep": False, "beta": beta, "cost_adjustment": "BIC", "pruning": 0.0, **more}


_TWO = f"SELECT d AS i, x, c * 30 AS c FROM ({DAILY})"
_SUMS2 = {"s1": "x", "s2": "c", "q1": "x * x", "q2": "c * c", "qq": "x * c"}
_S11, _S22, _S12 = "(<q1> - <s1> * <s1> / <m>)", "(<q2> - <s2> * <s2> / <m>)", "(<qq> - <s1> * <s2> / <m>)"


def two(spark, sf_dir) -> DataFrame:
    return daily(spark, sf_dir).withColumn("c", F.col("c") * 30)


# the inverse of [[40000, 10000], [10000, 3600]] is [[3600, -10000], [-10000, 40000]] / 4.4e7
_exact("cp_mean_two_columns", _one(_TWO, f"(3600 * {_S11} - 20000 * {_S12} + 40000 * {_S22}) / 4.4e7 / 2", _SUMS2, 12.0), lambda s, d: api.mean(two(s, d), ["x", "c"], "d", **_plain(12.0, variance=[[40000.0, 10000.0], [10000.0, 3600.0]])))
_DET = f"({_S11} * {_S22} - {_S12} * {_S12}) / <m> / <m>"
_exact("cp_meanvariance_two_columns", _one(f"SELECT d AS i, x, c FROM ({MONTHLY})", f"<m> / 2.0 * ln(CASE WHEN <m> < 3 THEN 1e-10 ELSE greatest({_DET}, 1e-10) END)", _SUMS2, 60.0), lambda s, d: api.meanvariance(monthly(s, d), ["x", "c"], "d", **_plain(60.0)))
_AB = {"yy": "y * y", "ay": "a * y", "bo": "b * y", "aa": "a * a", "ab": "a * b", "bb": "b * b"}
_exact(
    "cp_lm_two_predictors",
    _one("SELECT d AS i, y, a, b FROM (" + _SWITCH.format(x=LINES) + ")", "CASE WHEN <m> <= 2 THEN 0 ELSE greatest(<yy> - (<ay> * <ay> * <bb> - 2 * <ay> * <bo> * <ab> + <bo> * <bo> * <aa>) / (<aa> * <bb> - <ab> * <ab>), 0) / 2 END", _AB, 5000.0),
    lambda s, d: api.lm(switched(s, d), ["y", "a", "b"], "d", **_plain(5000.0, vanilla=1.0)),
)
_LAGGED = f"SELECT d AS i, x - 300 AS y, lag(x - 300) OVER (ORDER BY d) AS a FROM ({DAILY})"
_exact(
    "cp_ar_one_lag",
    f"WITH s AS ({_one('SELECT * FROM (' + _LAGGED + ') WHERE a IS NOT NULL', '(<yy> - <ay> * <ay> / <aa>) / 2', {'yy': 'y * y', 'ay': 'a * y', 'aa': 'a * a'}, 200_000.0)}) SELECT lag(end_index + 1, 1, 0) OVER (ORDER BY end_index) + 1 AS start_index, end_index + 1 AS end_index FROM s",
    lambda s, d: api.ar(daily(s, d).withColumn("x", F.col("x") - 300), "x", "d", order=1, **_plain(200_000.0, vanilla=1.0)),
)
_RSS = "((p.sq[d.t + 2] - p.sq[j + 2]) - (p.cr[d.t + 2] - p.cr[j + 2]) ** 2 / (p.sq[d.t + 1] - p.sq[j + 1]))"
_exact(
    "cp_arma_one_lag",
    _one(f"SELECT d AS i, x - 150 AS x, coalesce(lag(x - 150) OVER (ORDER BY d), 0) AS l FROM ({MONTHLY})", f"CASE WHEN <m> <= 2 THEN 0 ELSE (<m> - 1) / 2.0 * (ln(2 * pi() * greatest({_RSS} / (<m> - 1), 1e-300)) + 1) END", {"sq": "x * x", "cr": "x * l"}, 30.0),
    lambda s, d: api.arma(monthly(s, d).withColumn("x", F.col("x") - 150), "x", "d", order=(1, 0), **_plain(30.0)),
)
_exact(
    "cp_poisson_rate",
    _one(f"SELECT d AS i, c * (CASE WHEN d >= 1995 * 12 THEN 2 ELSE 1 END) AS y FROM ({MONTHLY})", "greatest(<l> - CASE WHEN <y> > 0 THEN <y> * ln(<y> / <m>) ELSE 0 END, 0)", {"y": "y", "l": "CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END"}, 12.0),
    lambda s, d: api.poisson(monthly(s, d).withColumn("c", F.col("c") * F.when(F.col("d") >= 1995 * 12, 2).otherwise(1)).withColumn("one", F.lit(1.0)), ["c", "one"], "d", **_plain(12.0, vanilla=1.0)),
)
_exact(
    "cp_mlm_means",
    _one(f"SELECT d AS i, x, c FROM ({MONTHLY})", "<m> / 2.0 * (2 * ln(2 * pi()) + ln(400.0 * 90.0)) + CASE WHEN <m> <= 2 THEN ((<q1> + (<m> - 2) * <s1> * <s1>) / 400 + (<q2> + (<m> - 2) * <s2> * <s2>) / 90) / 2 ELSE (" + _S11 + " / 400 + " + _S22 + " / 90) / 2 END", _SUMS2, 15.0),
    lambda s, d: api.lm(monthly(s, d).withColumn("one", F.lit(1.0)), ["x", "c", "one"], "d", responses=2, variance=[[400.0, 0.0], [0.0, 90.0]], **(_plain(15.0) | {"pruning": "exact"})),
)
_exact(
    "cp_kcp_given_features",
    _one(f"SELECT d AS i, cos(0.05 * x + 0.5) AS f, cos(-0.02 * x + 1.5) AS g FROM ({MONTHLY})", "(<q1> - <s1> * <s1> / <m> + <q2> - <s2> * <s2> / <m>) / 2", {"s1": "f", "s2": "g", "q1": "f * f", "q2": "g * g"}, 1.5),
    lambda s, d: api.kcp(monthly(s, d), "x", "d", extra={"weights": ([[0.05, -0.02]], [0.5, 1.5])}, **_plain(1.5)),
)
_MEDIAN = "(SELECT d AS i, x + CASE WHEN d >= 1995 * 12 THEN 40 ELSE 0 END AS x FROM (" + MONTHLY + "))"
_exact(
    "cp_quantile_median",
    _one(f"SELECT * FROM {_MEDIAN}", "list_sum(list_transform(p.a[j + 1 : d.t + 1], lambda v: abs(v - list_aggregate(p.a[j + 1 : d.t + 1], 'median')))) / 2", {"s": "x"}, 60.0).replace("list(s ORDER BY r) AS s", "list(s ORDER BY r) AS s, list(x ORDER BY r) AS a").replace("AS beta, s FROM", "AS beta, s, a FROM").replace("AS r, sum(x)", "AS r, x, sum(x)"),
    lambda s, d: api.quantile(monthly(s, d).withColumn("x", F.col("x") + F.when(F.col("d") >= 1995 * 12, 40).otherwise(0)).withColumn("one", F.lit(1.0)), ["x", "one"], "d", **_plain(60.0, vanilla=1.0, tau=0.5)),
)


_FITTED = f"WITH s AS ({optimal(EVENTS.format(x=LEVEL), _MEAN, 1, '2500.0::DOUBLE')}), e AS (SELECT k, i, x, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM ({EVENTS.format(x=LEVEL)})), f AS (SELECT s.k, start_index, end_index, i, r, x FROM s JOIN e ON s.k = e.k AND r BETWEEN start_index AND end_index)"


def _fitted(spark, sf_dir) -> api.Detection:
    return api.mean(events(spark, sf_dir), "x", "i", "k", keep=False, variance=[[2500.0]], **_BIC)


@query(f"{_FITTED} SELECT k, start_index, end_index, round((sum(x * x) - sum(x) * sum(x) / count(*)) / 5000, 3) AS cost, round(avg(x), 6) AS theta FROM f GROUP BY ALL")
def cp_mean_fits(spark, sf_dir):
    return _fitted(spark, sf_dir).segments.select("k", "start_index", "end_index", F.round("cost", 3).alias("cost"), F.round(F.get("theta", F.lit(0)), 6).alias("theta"))


@query(f"{_FITTED} SELECT k, r AS row_index, i AS order_value, round(x - avg(x) OVER (PARTITION BY k, start_index), 5) AS residual FROM f")
def cp_mean_residuals(spark, sf_dir):
    return _fitted(spark, sf_dir).residuals.select("k", "row_index", "order_value", F.round(F.get("residual", F.lit(0)), 5).alias("residual"))


def _rows(name: str, f: Callable[[SparkSession, str], api.Detection]) -> None:
    def run(spark, sf_dir):
        r = f(spark, sf_dir)
        return r.segments.select(*r.series.partition_by, "segment_id", "start_index", "end_index", F.round("cost", 3).alias("cost"))

    run.__name__ = name
    query()(run)


_rows("cp_mean_multivariate", lambda s, d: api.mean(daily(s, d), ["x", "c"], "d", keep=False))
_rows("cp_embedding_mean", lambda s, d: api.mean(s.read.parquet(f"{d}/embeddings.parquet"), "embedding", "vec_id", "label", keep=False, variance=np.eye(64).tolist()))
_rows("cp_var", lambda s, d: api.var(monthly(s, d), ["x", "c"], "d", order=1, keep=False))
_rows("cp_kcp", lambda s, d: api.kcp(monthly(s, d), "x", "d", keep=False, seed=1))
_rows("cp_lm", lambda s, d: api.lm(switched(s, d), ["y", "a", "b", "c"], "d", keep=False))
_rows("cp_mlm", lambda s, d: api.lm(monthly(s, d).withColumn("one", F.lit(1.0)), ["x", "c", "one"], "d", keep=False, responses=2))
_rows("cp_binomial", lambda s, d: api.binomial(switched(s, d).withColumn("y", (F.col("y") > 60).cast("double")).withColumn("a", F.col("a") / 25 - 1).withColumn("b", F.col("b") / 5 - 1), ["y", "a", "b"], "d", keep=False, trim=0.05))
_rows("cp_poisson", lambda s, d: api.poisson(monthly(s, d).withColumn("one", F.lit(1.0)).withColumn("z", F.col("x") / 150 - 1), ["c", "one", "z"], "d", keep=False, trim=0.05))
_rows("cp_quantile", lambda s, d: api.quantile(monthly(s, d).withColumn("one", F.lit(1.0)), ["x", "one"], "d", keep=False, tau=0.5, trim=0.05))
_rows("cp_lasso", lambda s, d: api.lasso(monthly(s, d).withColumn("z", F.col("x") / 150 - 1).withColumn("u", F.cos("d")).withColumn("c", F.col("c") / 100), ["c", "z", "u"], "d", keep=False))
_rows("cp_ar", lambda s, d: api.ar(daily(s, d), "x", "d", order=2, keep=False))
_rows("cp_garch", lambda s, d: api.garch(monthly(s, d).withColumn("x", F.col("x") / 15 - 10), "x", "d", order=(1, 0), keep=False))
_rows("cp_arma", lambda s, d: api.arma(monthly(s, d).withColumn("x", F.col("x") - 150), "x", "d", order=(1, 0), keep=False, trim=0.1))
_rows("cp_ma", lambda s, d: api.ma(monthly(s, d).withColumn("x", F.col("x") - 150), "x", "d", order=1, keep=False, trim=0.1))
_rows("cp_arima", lambda s, d: api.arima(monthly(s, d), "x", "d", order=(1, 1, 0), keep=False, trim=0.1))


def _loss(z, t):
    return ((z[:, 0] - z[:, 1:] @ t) ** 2).sum() / 2


_rows("cp_custom_segd", lambda s, d: api.custom(monthly(s, d).withColumn("one", F.lit(1.0)), ["x", "one"], "d", keep=False, cost=_loss, gradient=lambda z, t: -(z[-1, 0] - z[-1, 1:] @ t) * z[-1, 1:], hessian=lambda z, t: np.outer(z[-1, 1:], z[-1, 1:])))


@query()
def cp_mean_long(spark, sf_dir):
    df = select(spark, sf_dir, EVENTS.format(x=LEVEL), "events")
    return api.detect_long(df, "x", "i", "mean", chunk=4000, overlap=500)


_ALL = "SELECT event_id AS i, value + CASE WHEN event_id * 3 >= mx AND event_id * 3 < 2 * mx THEN 200 ELSE 0 END AS x FROM events, (SELECT max(event_id) AS mx FROM events) AS m"


@query(f"SELECT end_index AS cp_index FROM ({_one(_ALL, '(<q> - <s> * <s> / <m>) / 2 / 2500', {'s': 'x', 'q': 'x * x'}, 40.0)}) WHERE end_index < (SELECT count(*) FROM events)")
def cp_mean_long_given_variance(spark, sf_dir):
    """The chunk-and-merge plan beside the optimum over the whole series."""
    df = select(spark, sf_dir, _ALL, "events")
    return api.detect_long(df, "x", "i", "mean", chunk=4000, overlap=500, variance=[[2500.0]], beta=40.0, cost_adjustment="BIC", pruning=0.0).select("cp_index")


@query(optimal(EVENTS.format(x=LEVEL), _MEAN, 1, "2500.0::DOUBLE"))
def cp_sql_table_function(spark, sf_dir):
    sql.register(spark)
    options = '{"order_by": "i", "values": ["x"], "partition_by": ["k"], "variance": [[2500.0]], "beta": "BIC", "cost_adjustment": "BIC", "pruning": 0.0}'
    options = options.replace("{", "{{").replace("}", "}}")  # spark.sql fills in names in braces
    return spark.sql(f"SELECT k, start_index, end_index FROM changepoints(TABLE({{events}}) PARTITION BY k ORDER BY (i), 'mean', '{options}')", events=events(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
