"""Incremental segmentation of streams: the forward programme's state is kept for each key.

Only families whose cost needs no look at the whole series (mean with a given
variance, meanvariance, exponential), and a numeric penalty. Rows must come in
rising order; a late row raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "n long, last long, starts binary, best binary, sums binary, total binary, prior binary"


def _cost(family: str, m, s, q, variance: float):
    if family == "mean":
        return (q - s * s / m) / 2 / variance
    if family == "meanvariance":
        return m / 2 * np.log(np.maximum(q / m - (s / m) ** 2, 1e-10))
    return m * (np.log(np.maximum(s / m, 1e-300)) + 1)


class Online:
    """The programme for one series, a row at a time, with plain pruning (exact for these costs)."""

    def __init__(self, family: str, beta: float, variance: float = 1.0):
        if family not in ("mean", "meanvariance", "exponential"):
            raise ValueError("streams take the families mean, meanvariance and exponential")
        self.family, self.beta, self.variance = family, float(beta), float(variance)
        self.n = 0
        self.starts, self.best, self.prior = np.zeros(1, np.int64), np.array([-self.beta]), np.zeros(1, np.int64)
        self.sums, self.total = np.zeros((1, 2)), np.zeros(2)

    def add(self, x: float) -> int:
        """Takes a row; the start of the last segment as of now (rows before it)."""
        self.n += 1
        self.total = self.total + [x, x * x]
        m, d = self.n - self.starts, self.total - self.sums
        value = self.best + _cost(self.family, m, d[:, 0], d[:, 1], self.variance) + self.beta
        at = int(value.argmin())
        last, least = int(self.starts[at]), float(value[at])
        keep = value <= least + self.beta
        keep[at] = True
        self.starts, self.best, self.sums, self.prior = np.append(self.starts[keep], self.n), np.append(self.best[keep], least), np.vstack((self.sums[keep], self.total)), np.append(self.prior[keep], last)
        return last

    def dump(self) -> tuple:
        return tuple(a.tobytes() for a in (self.starts, self.best, self.sums, self.total, self.prior))

    def load(self, n: int, raw: tuple) -> None:
        self.n = n
        self.starts, self.best, self.total, self.prior = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1]), np.frombuffer(raw[3]), np.frombuffer(raw[4], np.int64)
        self.sums = np.frombuffer(raw[2]).reshape(-1, 2)


def detect_stream(stream: DataFrame, key: str, order: str, value: str, family: str, beta: float, variance: float = 1.0) -> DataFrame:
    """(key, order, last_change): for each arriving row, how many rows stand before the last segment so far."""
    Online(family, beta, variance)
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, before = Online(family, beta, variance), None
        if state.exists:
            n, before, *raw = state.get
            run.load(n, tuple(raw))
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for at, x in zip(rows[order].tolist(), rows[value].tolist()):
            if before is not None and at <= before:
                raise ValueError(f"row {at} of {k[0]!r} is late")
            before = at
            out.append(run.add(float(x)))
        state.update((run.n, int(before), *run.dump()))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "last_change": out})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, last_change long", _STATE, "append", GroupStateTimeout.NoTimeout)
