"""R's default random stream: Mersenne Twister with inversion, and the draws that the fixtures need."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np


class RStream:
    def __init__(self, seed: int):
        s = seed & 0xFFFFFFFF
        for _ in range(50):
            s = (69069 * s + 1) & 0xFFFFFFFF
        state = []
        for _ in range(625):
            s = (69069 * s + 1) & 0xFFFFFFFF
            state.append(s)
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[1:], np.uint32), "pos": 624}}

    def unif(self) -> float:
        u = int(self.bits.random_raw()) * 2.3283064365386963e-10
        return min(max(u, 0.5 * 2.328306437080797e-10), 1 - 0.5 * 2.328306437080797e-10)

    def norm(self, mean: float = 0.0, sd: float = 1.0) -> float:
        u = float(int(134217728 * self.unif())) + self.unif()
        return mean + sd * NormalDist().inv_cdf(u / 134217728)

    def norms(self, n: int, mean: float = 0.0, sd: float = 1.0) -> np.ndarray:
        return np.array([self.norm(mean, sd) for _ in range(n)])

    def unifs(self, n: int) -> np.ndarray:
        return np.array([self.unif() for _ in range(n)])

    def binoms(self, p: np.ndarray) -> np.ndarray:
        out = []
        for q in p:
            least = min(q, 1 - q)
            v = 0 if self.unif() < 1 - least else 1
            out.append(1 - v if q > 0.5 else v)
        return np.array(out, float)
