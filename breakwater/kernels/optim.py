"""Numerical fits used by cost families: plain numpy, no Spark."""

from __future__ import annotations

import math

import numpy as np


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


def log1pexp(v):
    return np.logaddexp(0.0, v)


def logistic(v):
    e = np.exp(-np.abs(v))
    return np.where(v >= 0, 1 / (1 + e), e / (1 + e))


def deviance(family: str, y: np.ndarray, mu: np.ndarray) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a, b: np.where(a > 0, a * np.log(a / b), 0.0)
        if family == "binomial":
            return float(2 * np.sum(part(y, mu) + part(1 - y, 1 - mu)))
        return float(2 * np.sum(part(y, mu) - (y - mu)))


def glm(family: str, x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, tolerance: float = 1e-8, most: int = 100) -> tuple[np.ndarray, float]:
    """Coefficients and deviance by iteratively reweighted least squares with step halving."""
    tiny = np.finfo(float).eps

    def mean(eta):
        return np.clip(logistic(np.clip(eta, -30, 30)), tiny, 1 - tiny) if family == "binomial" else np.maximum(np.exp(np.minimum(eta, 700)), tiny)

    if start is None:
        mu = (y + 0.5) / 2 if family == "binomial" else y + 0.1
        eta = np.log(mu / (1 - mu)) if family == "binomial" else np.log(mu)
        beta = None
    else:
        beta, eta = start, x @ start
        mu = mean(eta)
    old = deviance(family, y, mu)
    for _ in range(most):
        slope = np.maximum(mu * (1 - mu), tiny) if family == "binomial" else mu
        w = np.sqrt(slope)
        new = least_squares(x * w[:, None], (eta + (y - mu) / slope) * w)
        for _ in range(most):
            eta = x @ new
            mu = mean(eta)
            now = deviance(family, y, mu)
            if math.isfinite(now) and (beta is None or now <= old + tolerance * (abs(old) + 0.1) * 10):
                break
            if beta is None:
                break
            new = (new + beta) / 2
        beta = new
        if abs(now - old) / (abs(now) + 0.1) < tolerance:
            break
        old = now
    return beta, now


def quantile_fit(x: np.ndarray, y: np.ndarray, tau: float) -> np.ndarray:
    """Coefficients of a quantile regression by reweighted least squares."""
    ridge = 1e-6 * np.eye(x.shape[1])
    beta = solve(x.T @ x + ridge, x.T @ y)
    for _ in range(100):
        r = y - x @ beta
        w = np.where(r >= 0, tau, 1 - tau) / np.maximum(np.abs(r), 1e-6)
        new = solve((x * w[:, None]).T @ x + ridge, (x * w[:, None]).T @ y)
        done = np.linalg.norm(new - beta) < 1e-8
        beta = new
        if done:
            break
    return beta


def pinball(r: np.ndarray, tau: float) -> np.ndarray:
    return np.where(r >= 0, tau * r, (tau - 1) * r)


def lasso(gram: np.ndarray, xy: np.ndarray, n: int, penalty: float, beta: np.ndarray | None = None) -> np.ndarray:
    """Least |y - x b|^2 / 2n + penalty |b|_1 by coordinate descent on x'x and x'y."""
    p = len(xy)
    beta = np.zeros(p) if beta is None else beta.copy()
    scale, rest = np.diag(gram).copy(), xy - gram @ beta
    for _ in range(1000):
        most = 0.0
        for j in range(p):
            if scale[j] < 1e-300:
                continue
            z = rest[j] + scale[j] * beta[j]
            new = math.copysign(max(abs(z) - n * penalty, 0.0), z) / scale[j]
            step = new - beta[j]
            if step:
                rest -= gram[:, j] * step
                beta[j] = new
                most = max(most, abs(step))
        if most < 1e-7:
            break
    return beta


def lasso_cv(x: np.ndarray, y: np.ndarray, folds: int = 5, steps: int = 50) -> np.ndarray:
    """Coefficients at the largest penalty whose cross-validation error is within one standard error of the least."""
    n = len(y)
    gram, xy = x.T @ x, x.T @ y
    top = np.abs(xy).max() / n
    if top <= 0 or n < 2:
        return np.zeros(x.shape[1])
    path = np.exp(np.linspace(math.log(top), math.log(top / 1000), steps))
    folds = min(folds, n)
    errors = np.zeros((folds, steps))
    for f in range(folds):
        out = np.arange(n) % folds == f
        g, v, beta = gram - x[out].T @ x[out], xy - x[out].T @ y[out], None
        for k, penalty in enumerate(path):
            beta = lasso(g, v, int((~out).sum()), penalty, beta)
            errors[f, k] = np.mean((y[out] - x[out] @ beta) ** 2)
    mean, spread = errors.mean(axis=0), errors.std(axis=0, ddof=1) / math.sqrt(folds)
    best = int(mean.argmin())
    chosen = int(np.flatnonzero(mean <= mean[best] + spread[best])[0])
    beta = None
    for penalty in path[: chosen + 1]:
        beta = lasso(gram, xy, n, penalty, beta)
    return beta


def projected_bfgs(f, theta: np.ndarray, lower: np.ndarray, upper: np.ndarray, most: int = 200) -> np.ndarray:
    """A minimum of f (value, gradient) in a box; coordinates held at a bound rest until the gradient frees them."""
    theta = np.clip(theta, lower, upper)
    value, g = f(theta)
    h, held, still = np.eye(len(theta)), None, 0
    for _ in range(most):
        now = ((theta <= lower) & (g > 0)) | ((theta >= upper) & (g < 0))
        if held is None or (now != held).any():
            h, held = np.eye(len(theta)), now
        free = ~held
        if not free.any() or np.abs(g[free]).max() < 1e-8:
            break
        d = np.zeros_like(theta)
        d[free] = -(h[np.ix_(free, free)] @ g[free])
        if d @ g >= 0:
            h = np.eye(len(theta))
            d = np.where(free, -g, 0.0)
        step = 1.0
        for _ in range(50):
            new = np.clip(theta + step * d, lower, upper)
            there, ng = f(new)
            if there <= value + 1e-4 * (g @ (new - theta)):
                break
            step /= 2
        else:
            break
        s, y = new - theta, ng - g
        still = still + 1 if value - there <= 1e-14 * (1 + abs(value)) else 0
        if still > 1:
            break
        if np.abs(s).max() < 1e-14:
            break
        sy = s @ y
        if sy > 1e-12:
            left = np.eye(len(s)) - np.outer(s, y) / sy
            h = left @ h @ left.T + np.outer(s, s) / sy
        theta, value, g = new, there, ng
    return theta


def _recursion(u: np.ndarray, b: float) -> np.ndarray:
    """y[t] = u[t] + b * y[t-1] down the rows, by doubling."""
    y, step, power = u.copy(), 1, b
    while step < len(y) and abs(power) > 1e-300:
        y[step:] += power * y[:-step].copy()
        step, power = 2 * step, power * power
    return y


def garch_likelihood(x: np.ndarray, p: int, q: int, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the sum of log h + x^2 / h, and its gradient; presample variances are the mean square."""
    n, k, lag = len(x), len(theta), max(p, q)
    if theta[0] <= 0 or (theta[1:] < -1e-8).any():
        return 1e10, np.zeros(k)
    square = x * x
    start, m = float(square.mean()), n - lag
    if m <= 0:
        return 0.0, np.zeros(k)
    past = [square[lag - 1 - j : n - 1 - j] for j in range(q)]
    own = theta[0] + sum((theta[1 + j] * past[j] for j in range(q)), np.zeros(m))
    if p <= 1:
        b = theta[1 + q] if p else 0.0
        h = own.copy()
        if p:
            h[0] += b * start
            h = _recursion(h, b)
        rows = np.column_stack([np.ones(m), *past, *([np.concatenate(([start], h[:-1]))] if p else [])])
        if p:
            rows[0, 0] += b  # the presample variance counts as moving with the constant
            rows = _recursion(rows, b)
    else:
        every, slopes = np.full(n, start), np.zeros((n, k))
        slopes[:lag, 0] = 1.0
        for t in range(lag, n):
            every[t] = own[t - lag] + theta[1 + q :] @ every[t - p : t][::-1]
            slopes[t] = np.concatenate(([1.0], [c[t - lag] for c in past], every[t - p : t][::-1])) + theta[1 + q :] @ slopes[t - p : t][::-1]
        h, rows = every[lag:], slopes[lag:]
    if not (h > 0).all():
        return 1e10, np.zeros(k)
    ratio = square[lag:] / h
    return 0.5 * float(np.log(h).sum() + ratio.sum()), (0.5 * (1 - ratio) / h) @ rows


def garch(x: np.ndarray, p: int, q: int) -> tuple[float, np.ndarray]:
    """Negative log-likelihood and coefficients (constant, ARCH, GARCH)."""
    k = p + q + 1
    theta = np.full(k, 0.05)
    theta[0] = float(x @ x) / len(x) * (1 - 0.05 * (k - 1))

    def mean(v):
        value, g = garch_likelihood(x, p, q, v)
        return value / len(x), g / len(x)

    theta = np.maximum(projected_bfgs(mean, theta, np.zeros(k), np.full(k, np.inf)), 0.0)
    return garch_likelihood(x, p, q, theta)[0], theta


def nelder_mead(f, start: np.ndarray, most: int = 500, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    n = len(start)
    points = [start.copy()] + [start + (0.1 if not start[i] else 0.05 * max(abs(start[i]), 1)) * np.eye(n)[i] for i in range(n)]
    values = [f(x) for x in points]
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        middle = np.mean(points[:-1], axis=0)
        out = middle + (middle - points[-1])
        v = f(out)
        if v < values[0]:
            far = middle + 2 * (middle - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (out, v)
        elif v < values[-2]:
            points[-1], values[-1] = out, v
        else:
            near = middle + 0.5 * ((out if v < values[-1] else points[-1]) - middle)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (x - points[0]) for x in points[1:]]
                values = [values[0]] + [f(x) for x in points[1:]]
    i = int(np.argmin(values))
    return points[i], values[i]


def pac_to_ar(pac: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary AR model from partial autocorrelations in (-1, 1)."""
    ar = np.zeros(0)
    for r in pac:
        ar = np.append(ar - r * ar[::-1], r)
    return ar


def ar_to_pac(ar: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of an AR model: `pac_to_ar` undone one order at a time, the highest first."""
    ar, out = np.array(ar, float), []
    while len(ar):
        r = ar[-1]
        out.append(r)
        rest = ar[:-1]
        ar = (rest + r * rest[::-1]) / max(1 - r * r, 1e-12)
    return np.array(out[::-1])


def hannan_rissanen(x: np.ndarray, p: int, q: int, bound: float = 0.97) -> np.ndarray:
    """Start values [ar, ma] of an ARMA fit: residuals of a long AR model serve as the past innovations of a regression."""
    n, m, out = len(x), max(p, q), np.zeros(p + q)
    far = min(max(p + q + 5, 2 * (p + q)), (n - 1) // 2 if n > 2 else 1)
    noise = np.zeros(n)
    lags = lambda z, k, low: [z[low - j : n - j] for j in range(1, k + 1)]
    if far >= 1 and n > far + 1:
        past = np.column_stack(lags(x, far, far))
        noise[far:] = x[far:] - past @ least_squares(past, x[far:])
    if n > m + p + q:
        past = np.column_stack(lags(x, p, m) + lags(noise, q, m))
        if np.linalg.matrix_rank(past) == p + q:
            out = np.clip(least_squares(past, x[m:]), -bound, bound)
    return out


def brent(f, low: float, high: float, tolerance: float = 1e-8, most: int = 200) -> float:
    """Where f is least between low and high: the vertex of the parabola through the three best points, where that stays
    inside and moves by less than half of the step before last, else a golden section."""
    golden = (3 - math.sqrt(5)) / 2
    best = second = third = low + golden * (high - low)
    f_best = f_second = f_third = f(best)
    step = last = 0.0
    for _ in range(most):
        middle = (low + high) / 2
        near = tolerance * abs(best) + 1e-12
        if abs(best - middle) <= 2 * near - (high - low) / 2:
            break
        before, last = last, step
        a, b = (best - second) * (f_best - f_third), (best - third) * (f_best - f_second)
        top, bottom = (best - third) * b - (best - second) * a, 2 * (b - a)
        vertex = -top / bottom if bottom else math.inf
        if abs(before) > near and abs(vertex) < abs(before) / 2 and low < best + vertex < high:
            step = vertex
            if min(best + step - low, high - best - step) < 2 * near:
                step = math.copysign(near, middle - best)
        else:
            last = (high if best < middle else low) - best
            step = golden * last
        x = best + (step if abs(step) >= near else math.copysign(near, step))
        value = f(x)
        if value <= f_best:
            low, high = (best, high) if x >= best else (low, best)
            third, f_third, second, f_second, best, f_best = second, f_second, best, f_best, x, value
        else:
            low, high = (x, high) if x < best else (low, x)
            if value <= f_second or second == best:
                third, f_third, second, f_second = second, f_second, x, value
            elif value <= f_third or third in (best, second):
                third, f_third = x, value
    return best


def arma_likelihood(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Exact Gaussian (negative log-likelihood, variance, innovations) by a Kalman filter, the variance concentrated out."""
    n, r = len(x), max(len(ar), len(ma) + 1)
    phi, load = np.zeros(r), np.zeros(r)
    phi[: len(ar)] = ar
    load[0], load[1 : 1 + len(ma)] = 1.0, ma
    t = np.eye(r, k=1)
    t[:, 0] = phi
    v = np.outer(load, load)
    try:
        state = np.linalg.solve(np.eye(r * r) - np.kron(t, t), v.ravel()).reshape(r, r)
    except np.linalg.LinAlgError:
        return math.inf, math.nan, np.zeros(n)
    a, total, logs, out = np.zeros(r), 0.0, 0.0, np.zeros(n)
    for i in range(n):
        f = state[0, 0]
        if not f > 0:
            return math.inf, math.nan, out
        e = x[i] - a[0]
        gain = state[:, 0] / f
        out[i] = e
        total += e * e / f
        logs += math.log(f)
        a = t @ (a + gain * e)
        state = t @ (state - np.outer(gain, state[0])) @ t.T + v
    s = total / n
    return 0.5 * (n * (math.log(2 * math.pi * s) + 1) + logs) if s > 0 else math.inf, s, out


def arma(x: np.ndarray, p: int, q: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood, [ar, ma, variance], innovations); a pure AR model is conditional on its first p values."""
    n = len(x)
    if not q:
        m = n - p
        if m <= p:
            return 0.0, np.zeros(p + 1), np.zeros(max(m, 0))
        lagged = np.column_stack([x[p - j - 1 : n - j - 1] for j in range(p)])
        ar = least_squares(lagged, x[p:])
        r = x[p:] - lagged @ ar
        s = max(float(r @ r) / m, 1e-300)
        return m / 2 * (math.log(2 * math.pi * s) + 1), np.append(ar, s), r
    if n <= p + q + 1:
        return 0.0, np.zeros(p + q + 1), np.zeros(n)
    split = lambda u: (pac_to_ar(np.tanh(u[:p])), -pac_to_ar(np.tanh(u[p:])))
    start = hannan_rissanen(x, p, q)
    inside = np.clip(np.concatenate((ar_to_pac(start[:p]), ar_to_pac(-start[p:]))), -0.97, 0.97)
    best, value = nelder_mead(lambda u: arma_likelihood(x, *split(u))[0], np.arctanh(inside))
    ar, ma = split(best)
    value, s, out = arma_likelihood(x, ar, ma)
    return value, np.concatenate((ar, ma, [s])), out
