"""The segmentation of one ordered series: a forward dynamic programme with pruning.

`F[t]` is the least penalised cost of the first t rows. Candidates are the
starts of the last segment; those that exceed the least by more than beta less
the pruning constant are given up. Families with gradient steps may replace
the exact cost by that of running parameters, one update of all candidates'
parameters for each new row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from breakwater import spec as specs
from breakwater.kernels import bounded, families, optim, prepare

LOG2E = math.log2(math.e)


@dataclass
class Result:
    change_points: np.ndarray
    costs: np.ndarray
    thetas: list[np.ndarray]
    residuals: np.ndarray
    backpointers: np.ndarray


def _family(s: specs.Spec, z: np.ndarray, p: int, variance) -> families.Family:
    f = s.family
    if f in ("mean", "rank", "kcp"):
        return families.Mean(z, p, variance)
    if f in ("mgaussian", "var"):
        return families.MultiGaussian(z, p, s.responses, variance)
    if f in ("gaussian", "ar"):
        return families.Gaussian(z, p, s.epsilon)
    if f == "quantile":
        return families.Quantile(z, p, s.tau, s.epsilon)
    if f == "garch":
        return families.Garch(z, p, s.order)
    if f in ("arma", "ma", "arima"):
        order = {"arma": s.order, "ma": (0, *s.order), "arima": (s.order[0], s.order[-1])}[f]
        return families.Arma(z, p, order, s.include_mean and f == "arima")
    if f == "custom":
        return families.Custom(z, p, s)
    return {"variance": families.Variance, "meanvariance": families.MeanVariance, "exponential": families.Exponential, "binomial": families.Binomial, "poisson": families.Poisson, "lasso": families.Lasso}[f](z, p)


def adjusted(cost, m, adjustment: str, p: int):
    """The cost of a segment of length m with its length's share."""
    if adjustment == "BIC":
        return cost
    share = p * np.log(m) / 2
    return cost + share if adjustment == "MBIC" else cost * LOG2E + share * LOG2E


class Steps:
    """Running parameters of all candidates."""

    def __init__(self, family: families.Family, s: specs.Spec, blocks: np.ndarray, of_row: np.ndarray):
        p = family.p
        self.family, self.spec, self.blocks, self.of_row = family, s, blocks, of_row
        self.theta, self.total = np.zeros((0, p)), np.zeros((0, p))
        self.hessian = np.zeros((0, p, p))
        self.start = np.zeros(0, np.int64)
        free = s.lower is None
        self.lower = np.full(p, -np.inf) if free else np.array(s.lower, float)
        self.upper = np.full(p, np.inf) if free else np.array(s.upper, float)

    def seed(self, start: int) -> None:
        theta, p = self.blocks[self.of_row[start]][None, :], self.family.p
        h = self.spec.epsilon * np.eye(p)[None]
        if not isinstance(self.family, families.Custom):
            h = h + self.family.hessian(theta, start)
        self.theta, self.total = np.vstack((self.theta, theta)), np.vstack((self.total, theta))
        self.hessian = np.concatenate((self.hessian, h))
        self.start = np.append(self.start, start)

    def _one(self, k: np.ndarray, e: int, moving: np.ndarray) -> np.ndarray:
        family, s, theta = self.family, self.spec, self.theta[k]
        if isinstance(family, families.Custom):
            h, g = family.each(s.hessian, theta, self.start[k], e + 1), family.each(s.gradient, theta, self.start[k], e + 1)
            h = h.reshape(len(k), family.p, family.p)
        else:
            h, g = family.hessian(theta, e), family.pull(theta, e)
        self.hessian[k] += h
        lifted = self.hessian[k] + s.epsilon * np.eye(family.p)
        try:
            step = np.linalg.solve(lifted, g[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            step = (np.linalg.pinv(lifted) @ g[:, :, None])[:, :, 0]
        moving = s.momentum * moving - step
        rate = np.ones(len(k))
        if s.line_search != (1.0,):
            trials = np.array([family.losses(np.clip(theta + r * moving, self.lower, self.upper), self.start[k], e + 1) for r in s.line_search])
            rate = np.array(s.line_search)[trials.argmin(axis=0)]
        theta = np.clip(theta + rate[:, None] * moving, self.lower, self.upper)
        self.theta[k] = family.settle(theta, self.hessian[k], e + 1 - self.start[k])
        return moving

    def update(self, count: int, e: int) -> None:
        """Row e enters the first `count` candidates."""
        k = np.arange(count)
        if self.spec.epochs is None:
            self._one(k, e, np.zeros((count, self.family.p)))
        elif self.spec.line_search == (1.0,) and not isinstance(self.family, families.Custom):
            moving = self._one(k, e, np.zeros((count, self.family.p)))
            left = np.array([int(self.spec.epochs(int(m))) for m in e + 1 - self.start[:count]], int)
            # candidates walk their own rows side by side
            for _ in range(int(left.max(initial=0))):
                some = np.flatnonzero(left > 0)
                for r in range(int((e + 1 - self.start[some]).max())):
                    some = some[self.start[some] + r <= e]
                    moving[some] = self._one(some, self.start[some] + r, moving[some])
                left -= 1
        else:
            for i in k:
                one, moving = np.array([i]), np.zeros((1, self.family.p))
                moving = self._one(one, e, moving)
                for _ in range(int(self.spec.epochs(e + 1 - int(self.start[i])))):
                    for row in range(int(self.start[i]), e + 1):
                        moving = self._one(one, row, moving)
        self.total[:count] += self.theta[:count]

    def keep(self, mask: np.ndarray) -> None:
        self.theta, self.total, self.hessian, self.start = self.theta[mask], self.total[mask], self.hessian[mask], self.start[mask]

    def costs(self, count: int, t: int, adjustment: str) -> np.ndarray:
        m = t - self.start[:count]
        out = self.family.losses(self.total[:count] / m[:, None], self.start[:count], t)
        if isinstance(self.family, families.Custom):
            return out
        out = adjusted(out, m, adjustment, self.family.p)
        return np.where(m < (3 if isinstance(self.family, families.Lasso) else self.family.p), 0.0, out)

    def overwrite(self, count: int, fits: list[np.ndarray]) -> None:
        self.theta[:count] = fits
        self.total[:count] += self.theta[:count]


def _thin(points: np.ndarray, n: int, trim: float) -> np.ndarray:
    """Change points away from the ends; those that are too close meet in the middle."""
    kept = points[(points > trim * n) & (points < (1 - trim) * n)]
    kept = np.unique(np.append(kept, 0))
    close = np.flatnonzero(np.diff(kept) <= trim * n)
    if len(close):
        kept = (np.delete(kept, close) + np.delete(kept, close + 1)) // 2
    return kept[kept > 0]


def segment(z: np.ndarray, s: specs.Spec, residuals: bool = True) -> Result:
    """Change points of the rows of `z` in their order, with the segments' fits; residuals only if they are wanted."""
    z, s, variance, shift = prepare.prepare(np.asarray(z, float), s)
    n = len(z)
    if n < 2:
        return Result(np.zeros(0, np.int64), np.zeros(0), [], np.zeros(0), np.zeros(n + 1, np.int64))
    p = specs.parameter_count(s, z.shape[1])
    family = _family(s, z, p, variance)
    beta = prepare.beta(s, p, n, variance)
    stepping = family.gradient and s.vanilla < 1
    steps = None
    if family.gradient:
        edges = np.round(np.linspace(0, n, s.segment_count + 1)).astype(int) if n >= s.segment_count else np.array([0, n])
        fits = [family.fit(int(a), int(b), True) for a, b in zip(edges, edges[1:])]
        blocks = np.array([f[1] if len(f[1]) == p else np.zeros(p) for f in fits])
        of_row = np.searchsorted(edges, np.arange(n), "right") - 1
        if s.family == "lasso":
            sd = [math.sqrt(np.mean((family.y[a:b] - family.x[a:b] @ v) ** 2)) for a, b, v in zip(edges, edges[1:], blocks)]
            family.base = float(np.mean(sd)) * math.sqrt(2 * math.log(p)) if p > 1 else 0.0
            beta *= 1 + float(np.mean([(np.abs(v) > 0).sum() for v in blocks]))
        if s.warm_start and isinstance(family, families.Binomial):
            family.starts = blocks[of_row]
        if stepping:
            steps = Steps(family, s, blocks, of_row)
            steps.seed(0)
    limit = beta - specs.pruning_constant(s, p)
    last_exact = s.vanilla * n

    def exact(starts: np.ndarray, t: int, hold: int | None = None) -> np.ndarray:
        if steps is not None:
            got = [family.fit(int(a), t, False) for a in starts]
            if t - 1 < last_exact:
                steps.overwrite(len(starts), np.array([g[1] for g in got]))
            raw = np.array([g[0] for g in got])
        else:
            raw = family.costs(starts, t)
        return adjusted(raw, t - starts, s.adjustment, p)

    best = np.empty(n + 1)
    back = np.zeros(n + 1, np.int64)
    best[0] = -beta
    zero = np.zeros(1, np.int64)
    if stepping and 1 > last_exact:
        steps.update(1, 0)
        best[1] = float(steps.costs(1, 1, s.adjustment)[0])
    else:
        best[1] = float(exact(zero, 1)[0])
    room = np.empty(64, np.int64)
    room[:2] = 0, 1
    size = 2
    if stepping:
        steps.seed(1)
    quick = bool(family.columns) and not stepping
    if family.bounded and not stepping and (limit == math.inf or s.adjustment == "BIC" and limit >= beta):
        # what is given up could not have been the least: the optimum over all candidates
        bounded.backpointers(family, p, s.adjustment, beta, limit, best, back)
        del best
        return _finished(s, family, p, shift, back, residuals)
    if quick:
        return _finished(s, family, p, shift, _quick(family, s, p, beta, limit, best, back), residuals)
    for t in range(2, n + 1):
        starts = room[:size]
        if stepping and t > math.floor(last_exact):
            steps.update(size - 1, t - 1)
            costs = np.append(steps.costs(size - 1, t, s.adjustment), 0.0)
        elif stepping:
            costs = np.append(exact(starts[:-1], t), 0.0)
        else:
            costs = exact(starts, t)
        value = best[starts] + costs + beta
        at = int(value.argmin())
        best[t], back[t] = value[at], starts[at]
        keep = value <= value[at] + limit
        if not keep.all():
            starts = starts[keep]
            size = len(starts)
            room[:size] = starts
            if stepping:
                steps.keep(keep)
        if t == n:
            break
        if size == len(room):
            room = np.append(room, np.empty(size, np.int64))
        room[size] = t
        size += 1
        if stepping:
            steps.seed(t)
    return _finished(s, family, p, shift, back, residuals)


def _quick(family: families.Family, s: specs.Spec, p: int, beta: float, limit: float, best: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The backpointers of a family whose costs follow from running sums.

    Each candidate's start, sums and least cost up to its start stand side by side in rows of
    one table, so a step is a few operations on whole rows.
    """
    n = family.n
    columns = family.columns
    share = p * np.log(np.maximum(np.arange(n + 1), 1)) / 2 if s.adjustment != "BIC" else None
    room = np.empty((2 + len(columns), 64))
    starts = np.empty(64, np.int64)
    for k in (0, 1):
        starts[k] = k
        room[:, k] = (k, best[k] + beta, *(c[k] for c in columns))
    size = 2
    with np.errstate(divide="ignore", invalid="ignore"):
        for t in range(2, n + 1):
            now = room[:, :size]
            value = family.quick(t, t - now[0], *now[2:])
            if share is not None:
                value += share[t - starts[:size]]
                if s.adjustment == "MDL":
                    value *= LOG2E
            value += now[1]
            at = int(value.argmin())
            best[t], back[t] = value[at], starts[at]
            keep = value <= value[at] + limit
            kept = int(np.count_nonzero(keep))
            if kept < size:
                room[:, :kept] = now[:, keep]
                starts[:kept] = starts[:size][keep]
                size = kept
            if size == room.shape[1]:
                room, starts = np.concatenate((room, np.empty_like(room)), axis=1), np.concatenate((starts, np.empty_like(starts)))
            starts[size] = t
            room[0, size], room[1, size] = t, best[t] + beta
            for i, c in enumerate(columns):
                room[2 + i, size] = c[t]
            size += 1
    return back


def _finished(s: specs.Spec, family: families.Family, p: int, shift: int, back: np.ndarray, wanted: bool = True) -> Result:
    """Change points along the backpointers, and the segments' fits."""
    n = family.n
    points, t = [], n
    while t > 0:
        points.append(t)
        t = int(back[t])
    points = _thin(np.array(points[::-1]), n, s.trim)
    costs, thetas, parts = [], [], []
    if not s.cp_only:
        for a, b in zip([0, *points.tolist()], [*points.tolist(), n]):
            cost, theta, r = family.fit(a, b, True)
            costs.append(float(adjusted(cost, b - a, s.adjustment, p)))
            thetas.append(np.asarray(theta, float))
            if wanted:
                parts.append(np.asarray(r, float))
    rest = np.concatenate([r[:, None] if r.ndim == 1 else r for r in parts]) if parts else np.zeros(0)
    pad = shift if len(rest) and s.family in ("ar", "var") else 0
    if pad:
        rest = np.concatenate((np.full((pad, rest.shape[1]), np.nan), rest))
    return Result(points + shift, np.array(costs), thetas, rest, back)


__all__ = ["Result", "segment", "adjusted", "optim"]
