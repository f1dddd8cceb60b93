"""Cost families: the cost of candidate segments of one series.

A family has `costs(s, t)`, the exact costs of rows [s, t) for an array of
starts s, and `fit(s, t)`, the final (cost, parameters, residual rows). Where
costs of one column follow from running sums, `columns` are these sums by row
and `quick(t, m, ...)` the costs of candidates of lengths m from the sums at their
starts, which the recursion keeps side by side. For `bounded`, `level` is the mean or variance
that such a cost is made of, `bound` a cost that counts levels below `low` for less than `quick`
does, `least_level` what levels have to exceed for that, `noise` the rounding of a level times
its length, and `end` the number of rows before the first whose cost by itself is -inf.
Families with a gradient step also have `seed`, `step` and `running`, which
keep the state of all candidates in arrays of one row each.
"""

from __future__ import annotations

import math

import numpy as np

from breakwater.kernels import optim

_FLOOR = 1e-10


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))


def _log_det(m: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(np.linalg.det(m), _FLOOR))


def _rounding(*x: np.ndarray | float) -> float:
    return 4 * np.finfo(float).eps * float(sum(np.max(np.abs(a)) for a in x))


def _log_from(level: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The logarithm, below `low` its tangent there."""
    return np.log(np.maximum(level, low)) + (np.minimum(level / low, 1) - 1)


class Family:
    gradient = False
    columns: tuple[np.ndarray, ...] = ()
    additive = False  # costs of parts never exceed that of the whole
    least_level, noise = 0.0, 0.0

    def __init__(self, z: np.ndarray, p: int):
        self.z, self.n, self.p, self.end = z, len(z), p, len(z)

    @property
    def bounded(self) -> bool:
        return bool(self.columns) and bool(np.isfinite([c[-1] for c in self.columns]).all())

    def costs(self, s: np.ndarray, t: int) -> np.ndarray:
        return np.array([self.fit(int(i), t, False)[0] for i in s])

    def fit(self, s: int, t: int, final: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
        raise NotImplementedError


class Mean(Family):
    """Half the squared distances to the segment's mean, in units of the given covariance."""

    def __init__(self, z: np.ndarray, p: int, variance: np.ndarray):
        super().__init__(z, p)
        white = (z - z.mean(axis=0)) @ np.linalg.cholesky(np.linalg.inv(np.atleast_2d(variance)))
        self.sums = _running(white)
        self.squares = np.concatenate(([0.0], np.cumsum((white**2).sum(axis=1))))
        if z.shape[1] == 1:
            self.columns = self.sums[:, 0], self.squares
            self.noise = _rounding(self.squares[-1], 2 * np.max(np.abs(white)) * np.max(np.abs(self.sums)))

    additive = True

    def quick(self, t, m, one, squares):
        d = self.columns[0][t] - one
        return (self.squares[t] - squares - d * d / m) / 2

    def level(self, t, m, one, squares):
        return np.ones(np.shape(m))

    def bound(self, t, m, low, one, squares):
        return self.quick(t, m, one, squares)

    def costs(self, s, t):
        m = t - s
        if self.columns:
            return self.quick(t, m, *(c[s] for c in self.columns))
        d = self.sums[t] - self.sums[s]
        return (self.squares[t] - self.squares[s] - (d * d).sum(axis=1) / m) / 2

    def fit(self, s, t, final=True):
        mean = self.z[s:t].mean(axis=0)
        return float(self.costs(np.array([s]), t)[0]), mean, self.z[s:t] - mean


class Variance(Family):
    """Half the length times the log determinant of the covariance around the series' mean."""

    def __init__(self, z, p):
        super().__init__(z, p)
        self.d = z.shape[1]
        x = z - z.mean(axis=0)
        self.sums = _running((x[:, :, None] * x[:, None, :]).reshape(self.n, -1))
        if self.d == 1:
            self.columns = (self.sums[:, 0],)
            self.noise = _rounding(self.sums[-1])

    least_level = 3 * _FLOOR

    def quick(self, t, m, sums):
        return m / 2 * np.log(np.maximum((self.columns[0][t] - sums) / m, _FLOOR))

    def level(self, t, m, sums):
        return (self.columns[0][t] - sums) / m

    def bound(self, t, m, low, sums):
        return m / 2 * _log_from((self.columns[0][t] - sums) / m, low)

    def costs(self, s, t):
        s = np.asarray(s)
        if self.columns:
            return self.quick(t, t - s, self.columns[0][s])
        a, b = s.copy(), np.full(len(s), t)
        short = b - a < self.d  # a short segment takes neighbouring rows
        a[short] = np.maximum(a[short] - self.d, 0)
        b[short] = np.minimum(b[short] + self.d, self.n)
        cov = (self.sums[b] - self.sums[a]) / (b - a)[:, None]
        det = np.linalg.det(cov.reshape(-1, self.d, self.d))
        with np.errstate(divide="ignore", invalid="ignore"):
            return (t - s) / 2 * np.log(det)

    def fit(self, s, t, final=True):
        x = self.z[s:t]
        cov = np.atleast_2d(np.cov(x, rowvar=False, ddof=1 if t - s > 1 else 0))
        sd = np.sqrt(np.maximum(np.diag(cov), _FLOOR))
        return float(self.costs(np.array([s]), t)[0]), cov.ravel(), (x - self.z.mean(axis=0)) / sd


class MeanVariance(Family):
    """Half the length times the log determinant of the segment's own covariance."""

    def __init__(self, z, p):
        super().__init__(z, p)
        self.d = z.shape[1]
        x = z - z.mean(axis=0)
        self.sums, self.squares = _running(x), _running((x[:, :, None] * x[:, None, :]).reshape(self.n, -1))
        if self.d == 1:
            self.columns = self.sums[:, 0], self.squares[:, 0]
            self.noise = _rounding(self.squares[-1], 2 * np.max(np.abs(x)) * np.max(np.abs(self.sums)))

    least_level = 3 * _FLOOR

    def level(self, t, m, sums, squares):
        mean = (self.columns[0][t] - sums) / m
        return (self.columns[1][t] - squares) / m - mean * mean

    def quick(self, t, m, sums, squares):
        var = self.level(t, m, sums, squares)
        return m / 2 * np.log(np.where(var <= 0, _FLOOR, var))

    def bound(self, t, m, low, sums, squares):
        return m / 2 * _log_from(self.level(t, m, sums, squares), low)

    def costs(self, s, t):
        if self.columns:
            return self.quick(t, t - s, *(c[s] for c in self.columns))
        m = (t - s)[:, None]
        mean = (self.sums[t] - self.sums[s]) / m
        cov = (self.squares[t] - self.squares[s]) / m - (mean[:, :, None] * mean[:, None, :]).reshape(len(m), -1)
        det = np.linalg.det(cov.reshape(-1, self.d, self.d))
        return m[:, 0] / 2 * np.log(np.where(det <= 0, _FLOOR, det))

    def fit(self, s, t, final=True):
        x = self.z[s:t]
        mean, cov = x.mean(axis=0), np.atleast_2d(np.cov(x, rowvar=False, ddof=1 if t - s > 1 else 0))
        return float(self.costs(np.array([s]), t)[0]), np.concatenate((mean, cov.ravel())), (x - mean) / np.sqrt(np.maximum(np.diag(cov), _FLOOR))


class Exponential(Family):
    """Length times (log mean + 1), of the first column."""

    def __init__(self, z, p):
        super().__init__(z, p)
        self.sums = np.concatenate(([0.0], np.cumsum(z[:, 0])))
        self.columns = (self.sums,)
        self.noise = _rounding(self.sums[-1])
        still = self.sums[1:] == self.sums[:-1]
        self.end = int(still.argmax()) if still.any() else self.n

    @property
    def bounded(self):
        return super().bounded and bool((self.z[:, 0] >= 0).all())

    def quick(self, t, m, sums):
        return m * (np.log((self.sums[t] - sums) / m) + 1)

    def level(self, t, m, sums):
        return (self.sums[t] - sums) / m

    def bound(self, t, m, low, sums):
        return m * (_log_from((self.sums[t] - sums) / m, low) + 1)

    def costs(self, s, t):
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.quick(t, t - s, self.sums[s])

    def fit(self, s, t, final=True):
        mean = self.z[s:t].mean(axis=0)
        # a column of mean 0 has no rate: its parameter is infinite, its residuals are 0
        some = mean != 0
        over = np.where(some, mean, 1.0)
        return float(self.costs(np.array([s]), t)[0]), np.where(some, 1 / over, np.inf), np.where(some, self.z[s:t] / over - 1, 0.0)


class MultiGaussian(Family):
    """Regression with several responses of known covariance."""

    def __init__(self, z, p, q: int, variance: np.ndarray):
        super().__init__(z, p)
        self.q, self.k = q, z.shape[1] - q
        y, x = z[:, :q], z[:, q:]
        outer = lambda a, b: _running((a[:, :, None] * b[:, None, :]).reshape(self.n, -1))
        self.yy, self.xy, self.xx = outer(y, y), outer(x, y), outer(x, x)
        self.inverse = np.linalg.inv(np.atleast_2d(variance))
        self.constant = q * math.log(2 * math.pi) + np.linalg.slogdet(np.atleast_2d(variance))[1]

    def costs(self, s, t):
        m, q, k = t - s, self.q, self.k
        yy = (self.yy[t] - self.yy[s]).reshape(-1, q, q)
        xy = (self.xy[t] - self.xy[s]).reshape(-1, k, q)
        xx = (self.xx[t] - self.xx[s]).reshape(-1, k, k)
        used = xx.copy()
        used[m <= k + 1] = np.eye(k)  # too short to be fitted: x'x counts as the identity
        try:
            b = np.linalg.solve(used, xy)
        except np.linalg.LinAlgError:
            b = np.linalg.pinv(used) @ xy
        bt, yx = b.transpose(0, 2, 1), xy.transpose(0, 2, 1)
        rss = yy - bt @ xy - yx @ b + bt @ xx @ b
        return m / 2 * self.constant + np.einsum("ij,nji->n", self.inverse, rss) / 2

    def fit(self, s, t, final=True):
        y, x = self.z[s:t, : self.q], self.z[s:t, self.q :]
        b = optim.least_squares(x, y)
        return float(self.costs(np.array([s]), t)[0]), b.ravel(order="F"), y - x @ b


class Regression(Family):
    """Families of one response in column 0: exact fits and gradient steps."""

    gradient = True
    link = "gaussian"

    def __init__(self, z, p, epsilon=1e-10):
        super().__init__(z, p)
        self.y, self.x, self.epsilon = z[:, 0], np.ascontiguousarray(z[:, 1:]), epsilon

    def row(self, theta, e) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictors of row e, or of each candidate's own row, with their outer products and the linear predictor."""
        x = np.atleast_2d(self.x[e])
        return x, x[:, :, None] * x[:, None, :], (theta * x).sum(axis=1)

    def hessian(self, theta, e):
        return np.broadcast_to(self.row(theta, e)[1], (len(theta), self.p, self.p))

    def pull(self, theta, e):
        x, _, eta = self.row(theta, e)
        return (eta - self.y[e])[:, None] * x

    def loss(self, theta, s, t):
        r = self.y[s:t] - self.x[s:t] @ theta
        return float(r @ r) / 2

    def losses(self, theta, s, t):
        return np.array([self.loss(theta[i], int(s[i]), t) for i in range(len(s))])

    def settle(self, theta, hessian, m):
        return theta


class Gaussian(Regression):
    def __init__(self, z, p, epsilon=1e-10):
        super().__init__(z, p, epsilon)
        whole = z - 0.0
        self.sums = _running((whole[:, :, None] * whole[:, None, :]).reshape(self.n, -1))

    def losses(self, theta, s, t):
        v = np.column_stack((np.ones(len(s)), -theta))
        m = (self.sums[t] - self.sums[s]).reshape(len(s), self.p + 1, self.p + 1)
        return np.maximum(np.einsum("ni,nij,nj->n", v, m, v), 0) / 2

    def costs(self, s, t):
        m = (self.sums[t] - self.sums[s]).reshape(len(s), self.p + 1, self.p + 1)
        out, full = np.zeros(len(s)), t - s > self.p
        if full.any():
            yy, xy, xx = m[full, 0, 0], m[full, 1:, 0], m[full, 1:, 1:]
            b = np.linalg.pinv(xx, hermitian=True) @ xy[:, :, None]
            out[full] = np.maximum(yy - (xy * b[:, :, 0]).sum(axis=1), 0) / 2
        for i in np.flatnonzero(~full):
            a, b = int(s[i]), t
            r = self.y[a:b] - self.x[a:b] @ optim.least_squares(self.x[a:b], self.y[a:b])
            out[i] = r @ r / 2
        return out

    def fit(self, s, t, final=True):
        b = optim.least_squares(self.x[s:t], self.y[s:t])
        r = self.y[s:t] - self.x[s:t] @ b
        return float(r @ r) / 2, b, r


class Binomial(Regression):
    link = "binomial"

    def __init__(self, z, p, epsilon=1e-10):
        super().__init__(z, p, epsilon)
        self.starts: np.ndarray | None = None

    def hessian(self, theta, e):
        _, outer, eta = self.row(theta, e)
        m = optim.logistic(eta)
        return (m * (1 - m))[:, None, None] * outer

    def pull(self, theta, e):
        x, _, eta = self.row(theta, e)
        return (optim.logistic(eta) - self.y[e])[:, None] * x

    def loss(self, theta, s, t):
        eta = self.x[s:t] @ theta
        return float(np.sum(optim.log1pexp(eta) - self.y[s:t] * eta))

    def fit(self, s, t, final=True):
        b, d = optim.glm(self.link, self.x[s:t], self.y[s:t], None if self.starts is None or final or t - s < 10 * self.p else self.starts[t - 1])
        mu = optim.logistic(self.x[s:t] @ b) if self.link == "binomial" else np.exp(self.x[s:t] @ b)
        slope = mu * (1 - mu) if self.link == "binomial" else mu
        return d / 2, b, (self.y[s:t] - mu) / np.maximum(slope, 1e-300)


class Poisson(Binomial):
    link = "poisson"

    def __init__(self, z, p, epsilon=1e-10):
        super().__init__(z, p, epsilon)
        self.factorials = np.concatenate(([0.0], np.cumsum([math.lgamma(v + 1) for v in self.y])))

    def hessian(self, theta, e):
        _, outer, eta = self.row(theta, e)
        return np.minimum(np.exp(np.minimum(eta, 700)), 1e10)[:, None, None] * outer

    def pull(self, theta, e):
        x, _, eta = self.row(theta, e)
        return (np.exp(np.minimum(eta, 700)) - self.y[e])[:, None] * x

    def loss(self, theta, s, t):
        eta = self.x[s:t] @ theta
        return float(np.sum(np.exp(np.minimum(eta, 700)) - self.y[s:t] * eta) + self.factorials[t] - self.factorials[s])


class Quantile(Regression):
    def __init__(self, z, p, tau, epsilon=1e-10):
        super().__init__(z, p, epsilon)
        self.tau = tau

    def pull(self, theta, e):
        x, _, eta = self.row(theta, e)
        return ((self.y[e] - eta < 0) - self.tau)[:, None] * x

    def loss(self, theta, s, t):
        return float(optim.pinball(self.y[s:t] - self.x[s:t] @ theta, self.tau).sum())

    def fit(self, s, t, final=True):
        b = optim.quantile_fit(self.x[s:t], self.y[s:t], self.tau)
        r = self.y[s:t] - self.x[s:t] @ b
        return float(optim.pinball(r, self.tau).sum()), b, r


class Lasso(Gaussian):
    """Regression with an absolute penalty; `base` is set from the blocks' residuals."""

    base = 0.0

    def losses(self, theta, s, t):
        return super().losses(theta, s, t) + self.base / np.sqrt(t - s) * np.abs(theta).sum(axis=1)

    def settle(self, theta, hessian, m):
        less = self.base / np.sqrt(m) / np.linalg.norm(hessian, axis=(1, 2))
        return np.sign(theta) * np.maximum(np.abs(theta) - less[:, None], 0)

    def costs(self, s, t):
        return np.array([self.fit(int(i), t, False)[0] for i in s])

    def fit(self, s, t, final=True):
        if t - s == 1:
            return 0.0, np.zeros(self.p), np.zeros(0 if final else 1)
        x, y = self.x[s:t], self.y[s:t]
        b = optim.lasso_cv(x, y) if final else optim.lasso(x.T @ x, x.T @ y, t - s, self.base / math.sqrt(t - s))
        r = y - x @ b
        return float(r @ r) / (1 if final else 2), b, np.zeros(0) if final else r


class Garch(Family):
    def __init__(self, z, p, order):
        super().__init__(z, p)
        self.order = order

    def fit(self, s, t, final=True):
        x = self.z[s:t, 0]
        value, theta = optim.garch(x, *self.order)
        if not final:
            return value, theta, x
        lag, (p, q) = max(self.order), self.order
        h = [theta[0] / (1 - theta[1:].sum()) if theta[1:].sum() < 1 else float(x @ x) / len(x)] * min(lag, len(x))
        for i in range(lag, len(x)):
            h.append(theta[0] + sum(theta[1 + j] * x[i - 1 - j] ** 2 for j in range(q)) + sum(theta[1 + q + j] * h[i - 1 - j] for j in range(p)))
        r = x / np.sqrt(np.maximum(h, 1e-300))
        r[:lag] = np.nan
        return value, theta, r


class Arma(Family):
    def __init__(self, z, p, order, include_mean=False):
        super().__init__(z, p)
        self.order, self.include_mean = order, include_mean

    def fit(self, s, t, final=True):
        x = self.z[s:t, 0]
        mean = x.mean() if self.include_mean else 0.0
        value, theta, r = optim.arma(x - mean, *self.order)
        return (value if math.isfinite(value) else 0.0), (np.append(theta, mean) if self.include_mean else theta), r


class Custom(Family):
    """A cost given by the caller; with a gradient and a hessian it also has gradient steps.

    A cost of one parameter is minimised over the logit of a variable between 0
    and 1, and a segment's value is the logistic of its least cost. `batch_cost` takes the whole
    series, an array of starts and an end, and returns the costs of all those segments.
    """

    def __init__(self, z, p, spec):
        super().__init__(z, p)
        self.spec = spec
        self.gradient = spec.gradient is not None

    def costs(self, s, t):
        if self.spec.batch_cost is not None:
            return np.asarray(self.spec.batch_cost(self.z, np.asarray(s), t), float)
        return super().costs(s, t)

    def fit(self, s, t, final=True):
        data = self.z[s:t]
        if self.gradient and self.p == 1 and self.spec.lower is None:
            natural = lambda u: np.array([math.log(u / (1 - u))])
            u = optim.brent(lambda u: float(self.spec.cost(data, natural(u))), 0.0, 1.0)
            return float(optim.logistic(np.array(float(self.spec.cost(data, natural(u)))))), natural(u), np.zeros(0)
        if not self.gradient:
            if self.spec.cost is None:
                return float(self.costs(np.array([s]), t)[0]), np.zeros(0), np.zeros(0)
            return float(self.spec.cost(data)), np.zeros(0), np.zeros(0)
        lower, upper = np.full(self.p, -np.inf), np.full(self.p, np.inf)
        if self.spec.lower is not None:
            lower, upper = np.array(self.spec.lower, float), np.array(self.spec.upper, float)

        def f(theta):
            value, h = float(self.spec.cost(data, theta)), 1e-6
            g = [(self.spec.cost(data, theta + h * e) - self.spec.cost(data, theta - h * e)) / (2 * h) for e in np.eye(self.p)]
            return value, np.array(g, float)

        theta = optim.projected_bfgs(f, np.zeros(self.p), lower, upper)
        return float(self.spec.cost(data, theta)), theta, np.zeros(0)

    def each(self, fun, theta, s, t):
        return np.array([fun(self.z[int(a) : t], v) for a, v in zip(s, theta)], float)

    def losses(self, theta, s, t):
        return self.each(self.spec.cost, theta, s, t)

    def settle(self, theta, hessian, m):
        return theta
