"""SQL form of a segmentation, a table function.

SELECT * FROM changepoints(TABLE(q) PARTITION BY k ORDER BY (t), 'mean',
                           '{"order_by": "t", "values": ["x"], "partition_by": ["k"], "beta": "BIC"}')

The options name the order column, the value columns (all others by default) and the
partition columns, which are given out again; whatever else they hold goes to the
family. A statement without partition columns has WITH SINGLE PARTITION instead of
PARTITION BY. `changepoints_by(TABLE(q), 'mean', options)` is the same function
for statements that leave PARTITION BY and ORDER BY to the options.
"""

from __future__ import annotations

import array
import datetime
import json
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

from breakwater import spec as specs
from breakwater.kernels.segment import segment


def _columns(options: dict, names: list[str]) -> tuple[str, list[str], list[str]]:
    """(order column, value columns, partition columns), taken out of the options."""
    if "order_by" not in options:
        raise ValueError("the options of changepoints need order_by")
    order, keys = options.pop("order_by"), options.pop("partition_by", [])
    keys = [keys] if isinstance(keys, str) else list(keys)
    values = options.pop("values", None) or [c for c in names if c not in (order, *keys)]
    values = [values] if isinstance(values, str) else list(values)
    for c in (order, *keys, *values):
        if c not in names:
            raise ValueError(f"changepoints: there is no column {c!r}")
    return order, values, keys


_PACK = 65_536  # rows kept as Python objects at a time
_PLAIN = (int, float, str, datetime.date, datetime.datetime)


class _Rows:
    """The order and the values of a partition's rows: typed arrays, but for the last rows and for order columns of other types."""

    def __init__(self):
        self.values, self.last, self.packed = array.array("d"), [], []

    def add(self, order, values) -> None:
        self.last.append(order)
        self.values.extend([math.nan if v is None else v for v in values])
        if len(self.last) == _PACK:
            self.pack()

    def pack(self) -> None:
        kinds = {type(x) for x in self.last}
        if type(None) in kinds:
            raise ValueError("changepoints: the order column has nulls")
        plain = len(kinds) == 1 and kinds <= set(_PLAIN) and not getattr(self.last[0], "tzinfo", None)
        self.packed.append(pa.array(self.last) if plain else self.last)
        self.last = []

    def sorted(self, width: int) -> tuple[np.ndarray, Callable[[int], object]]:
        """Values by the order column, and the order value of a row."""
        if self.last:
            self.pack()
        values = np.frombuffer(self.values).reshape(-1, width)
        if all(isinstance(x, pa.Array) and x.type == self.packed[0].type for x in self.packed):
            at = pa.chunked_array(self.packed)
            by = pc.sort_indices(at).to_numpy()
        else:
            at = [y for x in self.packed for y in (x.to_pylist() if isinstance(x, pa.Array) else x)]
            by = np.array(sorted(range(len(at)), key=at.__getitem__))
        self.packed = []
        if len(by) and (by[1:] < by[:-1]).any():
            values = values[by]

        def place(i: int):
            x = at[int(by[i])]
            return x.as_py() if isinstance(x, pa.Scalar) else x

        return values, place


class _ChangePoints:
    def __init__(self):
        self.rows, self.columns, self.request, self.keys = _Rows(), None, None, ()

    @staticmethod
    def _schema(table: AnalyzeArgument, options: AnalyzeArgument | None) -> tuple[T.StructType, str, list[str]]:
        if not table.isTable:
            raise ValueError("changepoints takes a table first")
        fields = {f.name: f for f in table.dataType.fields}
        order, _, keys = _columns(json.loads(options.value if options else "{}"), list(fields))
        out = [fields[k] for k in keys] + [T.StructField(n, t) for n, t in (("segment_id", T.IntegerType()), ("start_index", T.LongType()), ("end_index", T.LongType()))]
        return T.StructType([*out, T.StructField("last_order", fields[order].dataType)]), order, keys

    @staticmethod
    def analyze(table: AnalyzeArgument, family: AnalyzeArgument = None, options: AnalyzeArgument = None) -> AnalyzeResult:
        return AnalyzeResult(_ChangePoints._schema(table, options)[0])

    def eval(self, row, family: str = "mean", options: str = "{}"):
        if self.request is None:
            given = json.loads(options)
            names = list(row.__fields__)
            order, values, keys = _columns(given, names)
            self.columns = names.index(order), [names.index(v) for v in values]
            self.request = specs.make(family, **given)
            self.keys = [row[k] for k in keys]
        order, values = self.columns
        self.rows.add(row[order], [row[v] for v in values])

    def terminate(self):
        if self.request is None:
            return
        values, place = self.rows.sorted(len(self.columns[1]))
        points = segment(values, self.request, residuals=False).change_points.tolist()
        edges = [0, *points, len(values)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            yield *self.keys, i, a + 1, b, place(b - 1)


class _Gathered(_ChangePoints):
    """The same, with the partition and the order asked for by the options."""

    @staticmethod
    def analyze(table: AnalyzeArgument, family: AnalyzeArgument = None, options: AnalyzeArgument = None) -> AnalyzeResult:
        schema, order, keys = _ChangePoints._schema(table, options)
        return AnalyzeResult(schema, withSinglePartition=not keys, partitionBy=[PartitioningColumn(k) for k in keys], orderBy=[OrderingColumn(order)])


def register(spark: SparkSession, name: str = "changepoints") -> None:
    """Registers `name`, whose statements have PARTITION BY, and `name`_by, where the options alone say so.

    Both give partition columns, segment_id, start_index, end_index, last_order of each segment.
    """
    spark.udtf.register(name, udtf(_ChangePoints))
    spark.udtf.register(f"{name}_by", udtf(_Gathered))
