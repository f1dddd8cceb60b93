"""The recursion with bounds: the least over all candidates, at a cost in proportion to the rows."""

import numpy as np
import pytest

from breakwater import spec
from breakwater.kernels import bounded, families, segment

BIC = {"beta": "BIC", "cost_adjustment": "BIC", "pruning": 0.0}
#: By query: family, its class, options.
CASES = {
    "cp_exponential": ("exponential", families.Exponential, BIC),
    "cp_mean_mbic_exact": ("mean", families.Mean, {"pruning": "exact"}),
    "cp_meanvariance": ("meanvariance", families.MeanVariance, BIC | {"beta": 200.0}),
    "cp_rank": ("rank", families.Mean, BIC),
    "cp_variance": ("variance", families.Variance, BIC),
}


def series(n: int, name: str, seed: int = 3) -> np.ndarray:
    r = np.random.default_rng(seed)
    x = r.exponential(50, n) + 0.01 if name == "cp_exponential" else r.normal(50, 20, n)
    x[n // 3 : 2 * n // 3] = x[n // 3 : 2 * n // 3] * 5 if name in ("cp_exponential", "cp_variance", "cp_meanvariance") else x[n // 3 : 2 * n // 3] + 200
    return x


def over_all(z: np.ndarray, family: str, options: dict, monkeypatch) -> segment.Result:
    """Every candidate at every row."""

    def backpointers(f, p, adjustment, beta, limit, best, back):
        run = bounded._Run(f, p, adjustment, beta, limit, best, back, f.n)
        with np.errstate(divide="ignore", invalid="ignore"):
            for t in range(2, f.n + 1):
                value = run.values(np.arange(t), t)
                back[t] = value.argmin()
                best[t] = value[back[t]]
        return back

    with monkeypatch.context() as m:
        m.setattr(bounded, "backpointers", backpointers)
        return segment.segment(z, spec.make(family, **options))


@pytest.mark.parametrize("name", CASES)
def test_work_grows_with_the_rows(name, monkeypatch):
    """Without a change for long, no candidate can be given up; few may be looked at all the same."""
    family, kind, options = CASES[name]
    seen = [0]
    quick = kind.quick

    def counted(self, t, m, *sums):
        seen[0] += np.size(m)
        return quick(self, t, m, *sums)

    monkeypatch.setattr(kind, "quick", counted)
    took = []
    for n in (6000, 24000):
        seen[0] = 0
        points = segment.segment(series(n, name), spec.make(family, **options)).change_points
        assert min(abs(points - n // 3)) <= 10 and min(abs(points - 2 * n // 3)) <= 10
        took.append(seen[0])
    assert took[1] < 6 * took[0]


@pytest.mark.parametrize("name", CASES)
def test_least_over_all_candidates(name, monkeypatch):
    family, _, options = CASES[name]
    r = np.random.default_rng(7)
    for n in (2, 3, 65, 66, 900, 2500):
        z = series(n, name, n)
        for x in (z, np.round(z, -1) + 10.0 * (name == "cp_exponential"), z + r.exponential(200, n) * (r.random(n) < 0.02), np.concatenate((z, z[::-1] * 2))):
            got, want = segment.segment(x, spec.make(family, **options)), over_all(x, family, options, monkeypatch)
            assert got.change_points.tolist() == want.change_points.tolist()
            assert got.costs == pytest.approx(want.costs)


def test_exponential_with_zeros(monkeypatch):
    """A row of 0 costs -inf by itself; whatever follows, its candidate or that after it stays the least."""
    for places in ([], [0], [0, 1], [40], [40, 41, 42, 80], [99]):
        z = series(100, "cp_exponential")
        z[places] = 0
        for options in (BIC, {"pruning": "exact"}):
            got, want = segment.segment(z, spec.make("exponential", **options)), over_all(z, "exponential", options, monkeypatch)
            assert got.backpointers.tolist() == want.backpointers.tolist()
