"""Segmentation kernels: expected change points on streams with fixed seeds, and properties."""

import math

import numpy as np
import pytest
from rstream import RStream

from breakwater import spec
from breakwater.kernels import optim, prepare
from breakwater.kernels.segment import segment


def run(z, family, order=None, **options):
    return segment(np.asarray(z, float), spec.make(family, order, **options))


def test_stream():
    assert RStream(1).norms(4) == pytest.approx([-0.626453810742332, 0.183643324222082, -0.835628612410047, 1.59528080213779])


def test_mean():
    r = RStream(1)
    z = np.concatenate((r.norms(300, 0, 10), r.norms(400, 50, 10), r.norms(300, 2, 10)))
    assert run(z, "mean").change_points.tolist() == [300, 700]


def test_variance():
    r = RStream(1)
    z = np.concatenate((r.norms(300), r.norms(400, 0, 10), r.norms(300)))
    assert run(z, "variance").change_points.tolist() == [300, 700]


def test_meanvariance():
    r = RStream(1)
    z = np.concatenate((r.norms(3000), r.norms(1000, 10), r.norms(3000, 10, 20), r.norms(1000)))
    assert run(z, "mv").change_points.tolist() == [3000, 4000, 7000]


def regression():
    r, n, p = RStream(1), 300, 4
    x = r.norms(n * p).reshape(n, p)
    theta = np.array([[1, 3.2, -1, 0], [-1, -0.5, 2.5, -2], [0.8, 0, 1, 2]])
    y = np.concatenate([x[a:b] @ t + r.norms(b - a, 0, 3) for a, b, t in zip((0, 100, 200), (100, 200, 300), theta)])
    return np.column_stack((y, x))


def test_linear_model():
    z = regression()
    assert prepare.block_variance(z)[0, 0] == pytest.approx(10.4922713, abs=1e-6)
    assert run(z, "lm").change_points.tolist() == [97, 201]


def test_binomial():
    r, n, p = RStream(1), 500, 4
    x = r.norms(n * p).reshape(n, p)
    a, b = r.norms(p), r.norms(p, 2)
    y = r.binoms(1 / (1 + np.exp(-np.concatenate((x[:300] @ a, x[300:] @ b)))))
    got = run(np.column_stack((y, x)), "binomial")
    assert got.change_points.tolist() == [302]
    assert got.thetas[0][0] == pytest.approx(-0.926018205, abs=1e-5)


def test_ar():
    r, x = RStream(1), np.zeros(1003)
    for i in range(1000):
        a, b, c = (0.6, -0.2, 0.1) if i < 600 else (0.3, 0.4, 0.2)
        x[i + 3] = a * x[i + 2] + b * x[i + 1] + c * x[i] + r.norm(0, 3)
    got = run(x[3:], "ar", 3)
    assert got.change_points.tolist() == [614]
    assert len(got.residuals) == 1000 and np.isnan(got.residuals[:3]).all()


def test_quantile():
    r = RStream(1)
    x = r.norms(400).reshape(2, 200).T
    y = np.concatenate((x[:100] @ [1, -1] + r.norms(100), x[100:] @ [-1, 1] + r.norms(100)))
    got = run(np.column_stack((y, x)), "quantile", tau=0.5)
    assert got.change_points.tolist() == [100]
    assert got.thetas[0] == pytest.approx([0.9882078, -1.0449301], abs=1e-3)


def test_var():
    r, n = RStream(1), 300
    one = np.array([-0.3, 0.6, -0.5, 0.4, 0.2, 0.2, 0.2, -0.2]).reshape(4, 2).T
    two = np.array([0.3, -0.4, 0.1, -0.5, -0.5, -0.2, -0.5, 0.2]).reshape(4, 2).T
    x = np.zeros((n + 2, 2))
    for i in range(n):
        x[i + 2] = (one if i < 200 else two) @ np.concatenate((x[i + 1], x[i])) + r.norms(2)
    assert run(x, "var", 2).change_points.tolist() == [204]


def test_kcp():
    r = RStream(1)
    z = np.concatenate((r.unifs(200) * 0.05, r.unifs(200)))
    assert run(z, "kcp", seed=1).change_points.tolist() == [200]


def test_garch():
    r, n = RStream(1), 120
    h, x = np.ones(n + 1), np.zeros(n + 1)
    for i in range(n):
        w, a, b = (10, 0.5, 0.3) if i < 60 else (0.2, 0.05, 0.1)
        h[i + 1] = w + a * x[i] ** 2 + b * h[i]
        x[i + 1] = r.norm(0, math.sqrt(h[i + 1]))
    got = run(x[1:], "garch", (1, 1))
    assert got.change_points.tolist() == [60]
    assert got.thetas[0] == pytest.approx([13.834633386, 0.227888554, 0.020084797], abs=1e-3)


def test_custom_cost_equals_mean():
    r = RStream(1)
    z = np.concatenate((r.norms(500), r.norms(500, 5)))
    beta = math.log(1000)
    options = {"beta": beta, "cost_adjustment": None}
    a = run(z, "mean", variance=[[1.0]], **options)
    b = run(z[::1], "custom", cost=lambda d: ((d - d.mean()) ** 2).sum() / 2, parameters=1, **options)
    assert a.change_points.tolist() == b.change_points.tolist() == [500]
    assert b.costs == pytest.approx([255.487731877, 278.914161918])


def test_custom_gradient():
    r, p = RStream(1), 5
    x = r.norms(1200 * p).reshape(-1, p)
    theta = np.zeros((3, 5))
    for i, m in enumerate((0, 5, 9)):
        theta[i, :2] = r.norms(2, m)
    truth = (x * np.repeat(theta, [400, 300, 500], axis=0)).sum(axis=1)
    factor = np.concatenate([2 * r.binoms(np.full(k, 0.95)) - 1 for k in (400, 300, 500)])
    z = np.column_stack((factor * truth + r.norms(1200), x))

    def loss(d, t):
        e = np.abs(d[:, 0] - d[:, 1:] @ t)
        return np.where(e <= 1, e**2 / 2, e - 0.5).sum()

    def gradient(d, t):
        e = d[-1, 0] - d[-1, 1:] @ t
        return -np.clip(e, -1, 1) * d[-1, 1:]

    def hessian(d, t):
        e = d[-1, 0] - d[-1, 1:] @ t
        return np.outer(d[-1, 1:], d[-1, 1:]) if abs(e) <= 1 else 0.01 * np.eye(p)

    got = run(z, "custom", cost=loss, gradient=gradient, hessian=hessian, trim=0.05)
    assert len(got.change_points) == 2 and abs(got.change_points - [418, 726]).max() <= 2


def test_lasso():
    r, n, p = RStream(1), 480, 50
    x = r.norms(n * p).reshape(n, p)
    theta = np.zeros((4, p))
    for i, (a, b) in enumerate(((-5, -2), (-3, 3), (2, 5), (-5, 5))):
        theta[i, :5] = a + (b - a) * r.unifs(5)
    y = np.concatenate([x[a:b] @ theta[i] + r.norms(b - a) for i, (a, b) in enumerate(((0, 80), (80, 200), (200, 320), (320, n)))])
    got = run(np.column_stack((y, x)), "lasso", epochs=lambda m: int(m < 30), cp_only=True)
    assert got.change_points.tolist() == [80, 200, 321]


def test_numpy_streams():
    np.random.seed(0)
    c = 100 * np.eye(3)
    z = np.concatenate([np.random.multivariate_normal([m] * 3, c, k) for m, k in ((0, 300), (50, 400), (2, 300))])
    assert run(z, "mean", trim=0.05).change_points.tolist() == [300, 700]
    np.random.seed(2)
    z = np.concatenate((np.random.normal(0, 1, 500), np.random.normal(0, 5, 500)))
    assert run(z, "variance", trim=0.05).change_points[0] == 501
    np.random.seed(3)
    z = np.concatenate((np.random.normal(0, 1, 300), np.random.normal(5, 3, 300)))
    assert run(z, "meanvariance", trim=0.05).change_points[0] == 300


@pytest.mark.parametrize("family", ["mean", "variance", "meanvariance", "exponential"])
def test_pruning_without_adjustment_is_exact(family):
    r = np.random.default_rng(7)
    z = np.concatenate((r.exponential(1, 80), r.exponential(4, 60), r.exponential(1, 90)))
    got = [run(z, family, beta="BIC", cost_adjustment="BIC", pruning=k) for k in (0.0, "exact")]
    assert got[0].change_points.tolist() == got[1].change_points.tolist()


def test_invariances():
    r = np.random.default_rng(1)
    z = np.concatenate((r.normal(0, 1, 100), r.normal(3, 1, 120)))
    assert run(z, "mean").change_points.tolist() == run(z + 1e6, "mean").change_points.tolist()
    assert run(z, "rank").change_points.tolist() == run(np.exp(z), "rank").change_points.tolist()


def test_arma_and_arima():
    r = np.random.default_rng(2)
    e = np.concatenate((r.normal(0, 1, 40), r.normal(0, 6, 40)))
    x = e.copy()
    for i in range(1, 80):
        x[i] += 0.5 * x[i - 1]
    got = run(x, "arma", (1, 0), trim=0.05)
    assert len(got.change_points) == 1 and abs(got.change_points[0] - 40) < 5
    got = run(np.cumsum(x), "arima", (1, 1, 0), trim=0.05)
    assert len(got.change_points) == 1 and abs(got.change_points[0] - 40) < 6
    value, theta, _ = optim.arma(x[:40], 1, 1)
    assert math.isfinite(value) and len(theta) == 3


def test_poisson_and_warm_start():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 2))
    y = r.poisson(np.exp(np.concatenate((x[:150] @ [1, 0.3], x[150:] @ [-1, 0.5]))))
    z = np.column_stack((y, x))
    for options in ({}, {"vanilla": 0.2}, {"warm_start": True, "vanilla": 0.1}, {"line_search": (1.0, 0.5)}, {"momentum": 0.1}, {"lower": [-3, -3], "upper": [3, 3]}):
        got = run(z, "poisson", **options).change_points
        assert len(got) and min(abs(got - 150)) < 10, options


@pytest.mark.parametrize(
    "arguments",
    [("nothing",), ("ar",), ("ar", 0), ("ar", (1, 1, 0)), ("var", (1, 2)), ("arima", (0, 0, 0)), ("arima", (1, 2)), ("garch", (0, 0)), ("garch", (1.5, 1)), ("ma", 0)],
)
def test_wrong_orders(arguments):
    with pytest.raises(ValueError):
        spec.make(*arguments)


def test_variance_of_an_arma_model():
    r, n = RStream(1), 300
    w, x = r.norms(n + 3, 0, 10), np.zeros(n + 3)
    for i in range(n):
        a = (0.1, -0.3, 0.1, 0.1, 0.5) if i < 200 else (0.3, 0.1, -0.3, -0.6, -0.1)
        x[i + 3] = a[0] * x[i + 2] + a[1] * x[i + 1] + a[2] * x[i] + a[3] * w[i + 2] + a[4] * w[i + 1] + w[i + 3]
    table = prepare.arma_variance(x[3:], 3, 2)
    assert prepare.arma_choice(table) == pytest.approx(100.25937, rel=1e-6)
    assert prepare.arma_choice(table, "aic") in table["sigma2"]


def test_covariance_of_a_mean_model():
    r = RStream(1)
    z = np.concatenate([10 * r.norms(3 * n).reshape(n, 3) + mean for n, mean in ((300, 0), (400, 50), (300, 2))])
    want = [[113.5442077, -0.1433207, -2.973472], [-0.1433207, 106.1627730, 8.430343], [-2.9734719, 8.4303433, 112.602989]]
    assert prepare.rice(z) == pytest.approx(np.array(want), rel=1e-6)
    assert run(z, "mean").change_points.tolist() == [300, 700]


def test_guards_of_matrices():
    assert prepare.guarded([[1.0, 1.0], [1.0, 1.0]]).tolist() == (1e-10 * np.eye(2)).tolist()
    assert prepare.guarded(4.0).tolist() == [[4.0]]
    fixed = prepare.nearest_positive(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert np.linalg.eigvalsh(fixed).min() >= 0 and fixed == pytest.approx(np.array([[1.5, 1.5], [1.5, 1.5]]))


def test_brent():
    assert optim.brent(lambda x: (x - 0.3) ** 2, 0, 1) == pytest.approx(0.3, abs=1e-6)
    assert optim.brent(lambda x: math.cosh(x - 2) - x, -5, 9) == pytest.approx(2 + math.asinh(1), abs=1e-6)
    assert optim.brent(lambda x: abs(x - 0.77), 0, 1) == pytest.approx(0.77, abs=1e-6)
    assert optim.brent(lambda x: x, 0, 1) == pytest.approx(0, abs=1e-6)


def test_partial_autocorrelations_and_back():
    r = np.random.default_rng(6)
    for k in range(1, 6):
        pac = r.uniform(-0.9, 0.9, k)
        assert optim.ar_to_pac(optim.pac_to_ar(pac)) == pytest.approx(pac)


def test_hannan_rissanen():
    r = np.random.default_rng(4)
    e = r.normal(size=4001)
    x = np.zeros(4001)
    for i in range(1, 4001):
        x[i] = 0.6 * x[i - 1] + e[i] + 0.4 * e[i - 1]
    assert optim.hannan_rissanen(x[1:], 1, 1) == pytest.approx([0.6, 0.4], abs=0.06)
    value, theta, _ = optim.arma(x[1:600], 1, 1)
    assert theta[:2] == pytest.approx([0.6, 0.4], abs=0.12)
    assert value <= optim.arma_likelihood(x[1:600], *np.split(optim.hannan_rissanen(x[1:600], 1, 1), 2))[0] + 1e-6
    assert optim.hannan_rissanen(np.ones(3), 1, 1).tolist() == [0, 0]


def test_custom_cost_of_one_parameter():
    """Exact fits go by Brent's method over the logit of a bounded variable; their value is the logistic of the cost."""
    r = np.random.default_rng(8)
    x = r.normal(size=120)
    y = (r.random(120) < 1 / (1 + np.exp(-1.5 * x))).astype(float)
    z = np.column_stack((y, x))
    loss = lambda d, t: float(np.sum(np.logaddexp(0, d[:, 1] * t[0]) - d[:, 0] * d[:, 1] * t[0])) / len(d)
    slope = lambda d, t: np.array([(1 / (1 + math.exp(-d[-1, 1] * t[0])) - d[-1, 0]) * d[-1, 1]])
    curve = lambda d, t: np.array([[d[-1, 1] ** 2 / 4]])
    got = run(z, "custom", cost=loss, gradient=slope, hessian=curve, cost_adjustment="BIC", beta=1e9)
    grid = np.linspace(-1, 5, 60_001)
    least = grid[np.argmin([loss(z, [t]) for t in grid[::100]]) * 100]
    assert got.thetas[0][0] == pytest.approx(least, abs=0.02)
    assert got.costs[0] == pytest.approx(1 / (1 + math.exp(-loss(z, [least]))), abs=1e-5)


def test_batch_cost_equals_single_costs():
    r = np.random.default_rng(9)
    z = np.concatenate((r.normal(0, 1, 150), r.normal(4, 1, 100)))
    sums, squares = np.concatenate(([0], np.cumsum(z))), np.concatenate(([0], np.cumsum(z * z)))
    many = lambda data, s, t: (squares[t] - squares[s] - (sums[t] - sums[s]) ** 2 / (t - s)) / 2
    options = {"parameters": 1, "beta": 8.0, "cost_adjustment": "BIC"}
    a = run(z, "custom", batch_cost=many, **options)
    b = run(z, "custom", cost=lambda d: ((d - d.mean()) ** 2).sum() / 2, **options)
    assert a.change_points.tolist() == b.change_points.tolist() == [150]
    assert a.costs == pytest.approx(b.costs)


def test_exponential_of_zeros():
    got = run(np.concatenate((np.zeros(20), np.ones(30))), "exponential", beta=1e9)
    assert np.isfinite(got.residuals).all()
    assert run(np.zeros(20), "exponential", beta=1e9).thetas[0].tolist() == [math.inf]


def test_wrong_options():
    for options in ({"cost_adjustment": "AIC"}, {"beta": "AIC"}, {"cost": len}, {"trim": 0.7}):
        with pytest.raises(ValueError):
            spec.make("mean", **options)
    for options in ({}, {"cost": lambda d: 0, "gradient": len}, {"cost": lambda d, t: 0}, {"cost": lambda d: 0, "gradient": len, "hessian": len}, {"cost": lambda: 0}):
        with pytest.raises(ValueError):
            spec.make("custom", **options)
    with pytest.raises(ValueError):
        spec.make("quantile", tau=1.0)
    with pytest.raises(ValueError):
        run(np.array([1.0, np.nan]), "mean")


def test_degenerate_series():
    assert run(np.ones(1), "mean").change_points.tolist() == []
    assert run(np.ones(50), "mean").change_points.tolist() == []
    assert run(np.zeros(0), "meanvariance").change_points.tolist() == []
