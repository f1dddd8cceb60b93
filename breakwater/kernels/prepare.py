"""What happens to a series before its segmentation: embedding, ranks, features, variance, penalty."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np

from breakwater import spec as specs


def rice(z: np.ndarray) -> np.ndarray:
    """Covariance of the noise from first differences."""
    d = np.diff(z, axis=0)
    return d.T @ d / (2 * max(len(d), 1))


def median_variance(x: np.ndarray) -> float:
    return float(2 * (2 * np.mean(np.abs(np.diff(x))) / 3) ** 2)


def block_variance(z: np.ndarray, q: int = 1, block: int | None = None, outlier_iqr: float = math.inf) -> np.ndarray:
    """Noise covariance of a regression from the coefficients of overlapping blocks of rows."""
    n, k = len(z), z.shape[1] - q
    b = k + 1 if block is None else block
    y, x = z[:, :q], z[:, q:]
    out = []
    for i in range(n - b):
        xa, xb = x[i : i + b], x[i + 1 : i + b + 1]
        try:
            ga, gb = xa.T @ xa, xb.T @ xb
            if min(1 / np.linalg.cond(ga), 1 / np.linalg.cond(gb)) < np.finfo(float).eps:
                continue
            ka, kb = np.linalg.inv(ga), np.linalg.inv(gb)
        except np.linalg.LinAlgError:
            continue
        ca, cb = ka @ xa.T @ y[i : i + b], kb @ xb.T @ y[i + 1 : i + b + 1]
        cross = ka @ kb @ (xa[1:].T @ xb[:-1])
        scale = float(np.trace(ka + kb - 2 * cross))
        d = ca - cb
        below = np.full((q, q), scale)
        if q > 1:
            apart = ((ca[:, :, None] - cb[:, None, :]) ** 2).sum(axis=0)
            below = below + np.where(np.eye(q, dtype=bool), 0.0, apart)
        out.append(d.T @ d / below)
    if not out:
        return np.full((q, q), np.nan)
    every = np.array(out)
    if q == 1:
        v = every[:, 0, 0]
        v = v[np.isfinite(v)]
        if math.isfinite(outlier_iqr):
            low, high = np.percentile(v, [25, 75])
            v = v[v < high + outlier_iqr * (high - low)]
        return np.array([[v.mean()]])
    return np.nanmean(every, axis=0)


def arma_variance(x: np.ndarray, p: int, q: int, most: int | None = None) -> dict[str, np.ndarray]:
    """Noise variances of AR models of orders 1 to `most` (p*q by default), with AIC and BIC."""
    most = max(p * q, 1) if most is None else most
    n, sigma = len(x), []
    for k in range(1, most + 1):
        z = np.column_stack([x[k - j : n - j] for j in range(k + 1)])
        sigma.append(float(block_variance(z)[0, 0]))
    sigma = np.array(sigma)
    order = np.arange(1, most + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        aic, bic = np.log(sigma) + 2 * order / n, np.log(sigma) + order * math.log(n) / n
    return {"order": order, "sigma2": sigma, "aic": aic, "bic": bic}


def arma_choice(table: dict[str, np.ndarray], by: str = "bic") -> float:
    """The noise variance of the order with the least `by` ("aic" or "bic") of an `arma_variance` table, the first of equals."""
    return float(table["sigma2"][int(np.nanargmin(table[by]))])


def nearest_positive(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors @ np.diag(np.maximum(values, np.finfo(float).eps)) @ vectors.T


def guarded(m: np.ndarray) -> np.ndarray:
    """The matrix, or a tiny multiple of the identity if it is singular."""
    m = np.atleast_2d(np.asarray(m, float))
    with np.errstate(all="ignore"):
        bad = not np.isfinite(m).all() or 1 / np.linalg.cond(m, 1) < 1e-10
    return 1e-10 * np.eye(len(m)) if bad else m


def ranks(z: np.ndarray) -> np.ndarray:
    """Ranks of each column with ties averaged, centred."""
    out = np.empty_like(z)
    for j in range(z.shape[1]):
        _, place, count = np.unique(z[:, j], return_inverse=True, return_counts=True)
        last = np.cumsum(count)
        out[:, j] = (last - (count - 1) / 2)[place] - (len(z) + 1) / 2
    return out


def bandwidth(z: np.ndarray, seed: int, rows: int = 1000) -> float:
    """The median heuristic on at most `rows` rows."""
    if len(z) > rows:
        z = z[np.sort(np.random.default_rng([seed, 1]).choice(len(z), rows, replace=False))]
    d = ((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2)
    d = d[np.triu_indices(len(z), 1)]
    d = d[d > 0]
    return math.sqrt(float(np.median(d)) / 2) if len(d) else 1.0


def fourier(z: np.ndarray, s: specs.Spec) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, from the spec's seed or its given weights."""
    given = s.extra.get("weights")
    if given is None:
        r = np.random.default_rng([s.seed, 2])
        width = s.bandwidth or bandwidth(z, s.seed)
        given = r.standard_normal((z.shape[1], s.features)) / width, r.uniform(0, 2 * math.pi, s.features)
    omega, phase = np.asarray(given[0], float), np.asarray(given[1], float)
    return math.sqrt(2 / omega.shape[1]) * np.cos(z @ omega + phase)


def embed(z: np.ndarray, p: int) -> np.ndarray:
    """Rows with their p predecessors, the latest first."""
    return np.hstack([z[p - j : len(z) - j] for j in range(p + 1)])


def prepare(z: np.ndarray, s: specs.Spec) -> tuple[np.ndarray, specs.Spec, np.ndarray | None, int]:
    """(data, spec, variance, how far change points move back)."""
    z = z[:, None] if z.ndim == 1 else z
    if z.dtype.kind != "f" or not np.isfinite(z).all():
        raise ValueError("the series holds null or non-finite values")
    shift, f, width = 0, s.family, z.shape[1]
    if len(z) < 2 + (s.order[0] if f in ("ar", "var") else s.order[1] if f == "arima" else 0):
        return z[:0], s, np.eye(width), 0
    if f in ("ar", "garch", "arima", "arma", "ma") and width != 1:
        raise ValueError(f"family {f!r} takes one column")
    if f == "ar":
        z, shift = embed(z, s.order[0]), s.order[0]
    elif f == "var":
        s = replace(s, responses=width)
        z, shift = embed(z, s.order[0]), s.order[0]
    elif f == "arima" and s.order[1]:
        z, shift = np.diff(z, n=s.order[1], axis=0), s.order[1]
    elif f == "rank":
        z = ranks(z)
    elif f == "kcp":
        beta = s.beta if not isinstance(s.beta, str) else (width + 2) * math.log(len(z)) / 2
        z, s = fourier(z, s), replace(s, beta=beta)
    elif f == "gaussian" and s.responses > 1:
        s = replace(s, family="mgaussian")
    if s.variance is not None:
        v = guarded(s.variance)
    elif f in ("mean", "rank"):
        v = guarded(rice(z))
    elif s.family in ("var", "mgaussian"):
        v = guarded(nearest_positive(block_variance(z, s.responses)))
    elif f in ("gaussian", "ar"):
        v = guarded(block_variance(z)) if isinstance(s.beta, str) else np.eye(1)
    else:
        v = np.eye(z.shape[1] if f == "kcp" else 1)
    return z, s, v, shift


def beta(s: specs.Spec, p: int, n: int, variance) -> float:
    out = specs.penalty(s.beta, p, n)
    return out * float(variance[0, 0]) if s.family in ("gaussian", "ar") and isinstance(s.beta, str) else out
