"""One function for each family, and `detect` for all: change points, segments and residuals as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from breakwater import spec as specs
from breakwater.plans import chunked, grouped
from breakwater.series import Series


@dataclass
class Detection:
    """The result of a run. The kernel runs once; its nested rows are kept on the executors' disks until `close`."""

    nested: DataFrame
    series: Series
    spec: specs.Spec

    @property
    def change_points(self) -> DataFrame:
        """keys, cp_index (1-based, the last row of the left segment), order_value."""
        return self.nested.select(*self.series.partition_by, F.explode("changes").alias("c")).select(*self.series.partition_by, "c.*")

    @property
    def segments(self) -> DataFrame:
        """keys, segment_id, start_index, end_index, cost, theta."""
        return self.nested.select(*self.series.partition_by, F.explode("segments").alias("c")).select(*self.series.partition_by, "c.*")

    @property
    def residuals(self) -> DataFrame:
        """keys, row_index, order_value, residual: the kernel runs once more for these."""
        return grouped.residuals(self.series, self.spec)

    @property
    def thetas(self) -> DataFrame:
        """keys, segment_id, parameter (from 0), value."""
        return self.segments.select(*self.series.partition_by, "segment_id", F.posexplode("theta").alias("parameter", "value"))

    def close(self) -> None:
        """Gives up the kept rows; they are made anew if asked for again."""
        self.nested.unpersist()

    def plot_frame(self) -> DataFrame:
        """Rows of the series with row_index, segment_id and whether a change follows: what a plot draws."""
        keys, order = self.series.partition_by, self.series.order_by
        points = self.nested.select(*keys, F.transform("changes", lambda c: c["cp_index"]).alias("__points"))
        rows = self.series.df.withColumn("row_index", F.row_number().over(self.series.window).cast("long"))
        joined = rows.join(points, keys) if keys else rows.crossJoin(F.broadcast(points))  # a single row
        return joined.select(*keys, order, *self.series.values, "row_index", F.size(F.filter("__points", lambda p: p < F.col("row_index"))).alias("segment_id"), F.array_contains("__points", F.col("row_index")).alias("is_change"))

    def summary(self, most: int = 20) -> str:
        """Text for at most `most` series."""
        lines = []
        for row in self.nested.select(*self.series.partition_by, "n_rows", F.transform("changes", lambda c: c["cp_index"]).alias("cps"), F.transform("segments", lambda c: c["cost"]).alias("costs")).limit(most).collect():
            name = ", ".join(f"{k}={row[k]}" for k in self.series.partition_by)
            lines += [f"Series {name}".rstrip() + f" ({row['n_rows']} rows), family {self.spec.family}", "Change points: " + (" ".join(map(str, row["cps"])) or "none"), "Costs: " + " ".join(f"{c:.6g}" for c in row["costs"]), ""]
        return "\n".join(lines).rstrip()


def detect(df: DataFrame, values: str | Sequence[str], order_by: str, partition_by: str | Sequence[str] | None = None, family: str = "mean", order=None, null_policy: str = "error", keep: bool = True, **options) -> Detection:
    """Segments every series of `df` by `family`; for regressions the response comes first in `values`."""
    series = Series.of(df, values, order_by, partition_by, null_policy)
    request = specs.make(family, order, **options)
    nested = grouped.run(series, request)
    return Detection(nested.persist(StorageLevel.DISK_ONLY) if keep else nested, series, request)


def detect_long(df: DataFrame, value: str, order_by: str, family: str = "mean", chunk: int = 50_000, overlap: int = 5_000, **options) -> DataFrame:
    """Change points of one very long series by the chunk-and-merge plan (approximate)."""
    return chunked.change_points(Series.of(df, value, order_by), specs.make(family, **options), chunk, overlap)


def _family(name: str):
    def f(df: DataFrame, values, order_by: str, partition_by=None, order=None, **options) -> Detection:
        return detect(df, values, order_by, partition_by, name, order, **options)

    f.__name__, f.__doc__ = name, f"`detect` with the family {name!r}."
    return f


mean, variance, meanvariance, exponential = (_family(x) for x in ("mean", "variance", "meanvariance", "exponential"))
lm, binomial, poisson, lasso, quantile = (_family(x) for x in ("lm", "binomial", "poisson", "lasso", "quantile"))
ar, var, arma, ma, arima, garch = (_family(x) for x in ("ar", "var", "arma", "ma", "arima", "garch"))
rank, kcp, custom = (_family(x) for x in ("rank", "kcp", "custom"))
mv = meanvariance


def ts(df: DataFrame, values, order_by: str, family: str, order, partition_by=None, **options) -> Detection:
    """Time-series families by name: ar, var, arma, ma, arima, garch."""
    if family not in specs.SEQUENTIAL:
        raise ValueError(f"the family must be one of {', '.join(specs.SEQUENTIAL)}; got {family!r}")
    return detect(df, values, order_by, partition_by, family, order, **options)
