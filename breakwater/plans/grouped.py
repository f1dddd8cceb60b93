"""Grouped plan: one shuffle by the series' keys, one kernel run for each series, one nested row out; residuals as rows in a plan of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from breakwater import spec as specs
from breakwater.kernels.segment import Result, segment
from breakwater.series import Series


def order_kind(s: Series) -> str:
    return dict(s.df.dtypes)[s.order_by]


def schema(s: Series) -> str:
    kinds = dict(s.df.dtypes)
    k = order_kind(s)
    return ", ".join(
        [
            *(f"`{c}` {kinds[c]}" for c in s.partition_by),
            "n_rows bigint",
            f"changes array<struct<cp_index:bigint,order_value:{k}>>",
            "segments array<struct<segment_id:int,start_index:bigint,end_index:bigint,cost:double,theta:array<double>>>",
        ]
    )


def residual_schema(s: Series) -> str:
    kinds = dict(s.df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in s.partition_by), f"row_index bigint, order_value {order_kind(s)}, residual array<double>"])


_ROWS = 65_536  # rows of residuals in a batch


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of numbers or of arrays of them; nulls are NaN."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).astype(float, copy=False)[:, None]
    lengths = set(column.value_lengths().unique().to_pylist())
    if len(lengths) > 1 or None in lengths:
        raise ValueError("the series holds null arrays or arrays of several lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _series(batches: Iterator[pa.RecordBatch], values: list[str], order: str) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Order column and values of a series in its order: of each batch nothing else is kept."""
    places, numbers = [], []
    for batch in batches:
        places.append(batch.column(order))
        numbers.append(np.hstack([_numbers(batch.column(v)) for v in values]))
    at, z = pa.chunked_array(places), np.concatenate(numbers)
    del numbers, places
    bad = at.null_count > 0 or pa.types.is_floating(at.type) and pc.any(pc.is_nan(at)).as_py()
    by = pc.sort_indices(at).to_numpy()
    if (by[1:] < by[:-1]).any():
        at, z = at.take(pa.array(by)), z[by]
    del by
    if bad or len(at) > 1 and pc.any(pc.equal(at[1:], at[:-1])).as_py():
        raise ValueError(f"the order column {order!r} has nulls or repeats within a series")
    return at, z


def _series_row(key: tuple, batches: Iterator[pa.RecordBatch], s: specs.Spec, values: list[str], order: str, keys: list[str]) -> pa.RecordBatch:
    at, z = _series(batches, values, order)
    r: Result = segment(z, s, residuals=False)
    points = r.change_points.tolist()
    edges = [0, *points, len(z)]
    segments = [{"segment_id": i, "start_index": edges[i] + 1, "end_index": edges[i + 1], "cost": float(c), "theta": np.asarray(t, float).ravel().tolist()} for i, (c, t) in enumerate(zip(r.costs, r.thetas))]
    changes = [{"cp_index": c, "order_value": at[c - 1].as_py()} for c in points]
    change = pa.struct([("cp_index", pa.int64()), ("order_value", at.type)])
    part = pa.struct([("segment_id", pa.int32()), ("start_index", pa.int64()), ("end_index", pa.int64()), ("cost", pa.float64()), ("theta", pa.list_(pa.float64()))])
    columns = [*(pa.array([k.as_py()], k.type) for k in key), pa.array([len(z)], pa.int64()), pa.array([changes], pa.list_(change)), pa.array([segments], pa.list_(part))]
    return pa.RecordBatch.from_arrays(columns, [*keys, "n_rows", "changes", "segments"])


def _residual_rows(key: tuple, batches: Iterator[pa.RecordBatch], s: specs.Spec, values: list[str], order: str, keys: list[str]) -> Iterator[pa.RecordBatch]:
    at, z = _series(batches, values, order)
    rest = segment(z, s).residuals
    n = min(len(rest), len(z)) if rest.ndim == 2 else 0
    del z
    for a in range(0, n, _ROWS):
        part = rest[a : min(a + _ROWS, n)]
        m, width = part.shape
        residual = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width), pa.array(part.ravel()))
        places = at.slice(a, m).combine_chunks()
        columns = [*(pa.repeat(k, m) for k in key), pa.array(np.arange(a + 1, a + m + 1)), places, residual]
        yield pa.RecordBatch.from_arrays(columns, [*keys, "row_index", "order_value", "residual"])


def dealt(s: Series) -> DataFrame:
    """The rows by their keys, over a fixed number of tasks: rows are small beside a kernel's work, so tasks are not joined by their size."""
    if not s.partition_by:
        return s.df
    return s.df.repartition(2 * int(s.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *s.partition_by)


def run(s: Series, spec: specs.Spec) -> DataFrame:
    """One row for each series: keys, n_rows, changes, segments."""
    values, order, keys = s.values, s.order_by, s.partition_by

    def kernel(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _series_row(key, batches, spec, values, order, keys)

    return dealt(s).groupBy(*keys).applyInArrow(kernel, schema(s))


def residuals(s: Series, spec: specs.Spec) -> DataFrame:
    """One row for each row of the series: keys, row_index, order_value, residual. A kernel run of its own, made only if asked for."""
    values, order, keys = s.values, s.order_by, s.partition_by

    def kernel(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _residual_rows(key, batches, spec, values, order, keys)

    return dealt(s).groupBy(*keys).applyInArrow(kernel, residual_schema(s))
