"""A series in a DataFrame: value columns, the columns that order the rows, and those that part it into many series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _names(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


@dataclass
class Series:
    """`df` with `values` (doubles), ordered by the one column `order_by` within each `partition_by`."""

    df: DataFrame
    values: list[str]
    order_by: str
    partition_by: list[str]

    @classmethod
    def of(cls, df: DataFrame, values: str | Sequence[str], order_by: str, partition_by: str | Sequence[str] | None = None, null_policy: str = "error") -> Series:
        """Only the needed columns, values as doubles; an array column of values is one column."""
        names, keys = _names(values), _names(partition_by)
        if not names:
            raise ValueError("name one value column at least")
        if null_policy not in ("error", "drop"):
            raise ValueError("null_policy is 'error' or 'drop'")
        kinds = dict(df.dtypes)
        for c in (*names, order_by, *keys):
            if c not in kinds:
                raise ValueError(f"there is no column {c!r}")
        for c in names:
            if not (kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") or kinds[c].startswith(("decimal", "array<"))):
                raise ValueError(f"column {c!r} of type {kinds[c]} is not numeric")
        cast = [F.col(c).cast("array<double>" if kinds[c].startswith("array<") else "double").alias(c) for c in names]
        small = df.select(*keys, order_by, *cast)
        if null_policy == "drop":
            for c in names:
                small = small.where(F.col(c).isNotNull() & (~F.isnan(c) if not kinds[c].startswith("array<") else F.lit(True)))
        return cls(small, names, order_by, keys)

    @property
    def window(self):
        """All rows of a series in order, for lags."""
        return Window.partitionBy(*self.partition_by).orderBy(self.order_by)

    @property
    def running(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self):
        return Window.partitionBy(*self.partition_by)

    def with_df(self, df: DataFrame, values: Sequence[str]) -> Series:
        return Series(df, list(values), self.order_by, self.partition_by)
