"""The exact recursion for families whose costs follow from running sums, over blocks of rows.

No candidate is left out: most are only not looked at while a bound says that they can't be
the least. A segment's cost is at least the sum of its two parts' costs, so a candidate whose
value was v when rows up to t0 were in has at least v + cost(t0, t) later on. Candidates that
are no longer young are put into groups, of which only the least value, t0 and the sums at t0
are held against the least cost of each row; a group is looked through when its bound does not
exceed that. Groups of like size are joined, so there are about as many as the logarithm of
the candidates. The young ones and those close to the least (the front) are evaluated for a
block of rows at once.

Levels (variances, means) of short segments may be tiny and their costs far below others; the
bounds take levels of at least `low`, half of the least level in the group, which no member's
segment falls under until it has twice the length it had at t0 (`until`).
"""

from __future__ import annotations

import math

import numpy as np

LOG2E = math.log2(math.e)
BLOCK = 64  # rows at once
FRONT = 192  # candidates in front before some are put into a group
YOUNG = 64  # the youngest of these stay
CLOSE = 32  # and as many of the least
STEP = 1 << 17  # members evaluated at once
_EPS = np.finfo(float).eps


class _Group:
    __slots__ = ("starts", "since", "least", "low", "until")

    def __init__(self, starts, since, least, low, until):
        self.starts, self.since, self.least, self.low, self.until = starts, since, least, low, until


class _Run:
    def __init__(self, family, p: int, adjustment: str, beta: float, limit: float, best: np.ndarray, back: np.ndarray, n: int):
        self.family, self.beta, self.limit, self.best, self.back, self.n = family, beta, limit, best, back, n
        self.columns = family.columns
        self.scale = LOG2E if adjustment == "MDL" else 1.0
        self.share = p * np.log(np.maximum(np.arange(n + 1), 1)) / 2 if adjustment != "BIC" else None
        self.front = np.arange(2)
        self.groups: list[_Group] = []
        self.table: tuple | None = None
        self.rows = BLOCK

    def costs(self, starts: np.ndarray, t) -> np.ndarray:
        """Costs with the lengths' shares."""
        m = t - starts
        value = self.family.quick(t, m, *(c[starts] for c in self.columns))
        if self.share is not None:
            value += self.share[m]
            if self.scale != 1.0:
                value *= LOG2E
        return value

    def values(self, starts: np.ndarray, t) -> np.ndarray:
        value = self.costs(starts, t)
        value += self.best[starts] + self.beta
        return value

    def dropped(self, starts: np.ndarray, value: np.ndarray, t: int) -> np.ndarray:
        """Which candidates can't be the least any more, as best[t] is known."""
        if self.limit < math.inf:
            return value > self.best[t] + self.limit
        if not self.family.additive:
            return np.zeros(len(value), bool)
        # with every length's share: from t on a segment that starts at t has the smaller one
        rest = value if self.share is None else value - self.share[t - starts] * self.scale
        return rest > self.best[t] + self.beta + 1e-9 * (1 + abs(self.best[t]))

    def group(self, starts: np.ndarray, t: int) -> None:
        """Puts candidates into a group as of t; those without a bound, or close to the least where few are, go to the front."""
        kept, value, level = [], [], []
        for a in range(0, len(starts), STEP):
            some = starts[a : a + STEP]
            v = self.values(some, t)
            stays = ~self.dropped(some, v, t)
            some, v = some[stays], v[stays]
            kept.append(some)
            value.append(v)
            level.append(self.family.level(t, t - some, *(c[some] for c in self.columns)))
        starts, value, level = (np.concatenate(x) for x in (kept, value, level))
        # a bound needs levels far over rounding and the floor
        sound = level > max(self.family.least_level, 100 * self.family.noise)
        front = ~sound
        near = np.flatnonzero(sound & (value < self.best[t] + self.beta / 2))
        if len(near) > CLOSE:
            near = near[np.argpartition(value[near], CLOSE)[:CLOSE]]
        front[near] = True
        if front.any():
            self.front = np.sort(np.concatenate((self.front, starts[front])))
            starts, value, level = starts[~front], value[~front], level[~front]
        if len(starts):
            low = 0.49 * float(level.min())
            least = float(value.min())
            slack = 4 * self.family.noise / low + 64 * _EPS * abs(least)
            self.groups.append(_Group(starts, t, least - slack, low, self.n if self.family.additive else 2 * t - int(starts.max())))
        self.table = None

    def seal(self, t: int) -> None:
        """Puts most of the front into a group and joins groups of like size."""
        value = self.values(self.front[:-1], t - 1)
        dropped = self.dropped(self.front[:-1], value, t - 1)
        stays = self.front >= t - YOUNG
        goes = ~stays & ~np.append(dropped, False)
        old = np.flatnonzero(goes)
        if len(old) > CLOSE:
            old = old[np.argpartition(value[old], CLOSE)[:CLOSE]]
        goes[old] = False
        stays[old] = True
        out = self.front[goes]
        self.front = self.front[stays]
        if len(out):
            while self.groups and len(self.groups[-1].starts) <= 2 * len(out):
                out = np.concatenate((self.groups.pop().starts, out))
            self.group(out, t - 1)

    def bounds(self, ts: np.ndarray) -> np.ndarray:
        """Groups by rows."""
        if self.table is None:
            g = self.groups
            since = np.array([x.since for x in g])
            self.table = since[:, None], np.array([x.least for x in g])[:, None], np.array([x.low for x in g])[:, None], np.array([x.until for x in g]), [c[since][:, None] for c in self.columns]
        since, least, low, _, sums = self.table
        return least + self.scale * self.family.bound(ts, ts - since, low, *sums)

    def look(self, which: np.ndarray, t: int) -> None:
        """Evaluates the members of some groups as of t."""
        some = [self.groups[i] for i in which]
        self.groups = [g for i, g in enumerate(self.groups) if i not in set(which.tolist())]
        for g in some:
            self.group(g.starts, t)
        self.groups.sort(key=lambda g: -len(g.starts))
        self.table = None

    def block(self, t: int) -> int:
        """Settles some rows from t on; gives the next one."""
        best, back, rows = self.best, self.back, min(self.rows, self.n + 1 - t)
        if self.groups:
            if self.table is None:
                self.bounds(np.array([t]))
            late = np.flatnonzero((self.table[3] < t + rows - 1) & (self.table[0][:, 0] < t - 1))
            if len(late):
                self.look(late, t - 1)
                return t
            rows = min(rows, int(self.table[3].min()) - t + 1)
        ts = np.arange(t, t + rows)
        value = self.values(self.front[:, None], ts)
        at = value.argmin(axis=0)
        least, origin = value[at, np.arange(len(ts))], self.front[at]
        # candidates within the block, as if its rows' least costs came from earlier ones; mended from row to row where not
        k = len(ts)
        if k > 1:
            inner = np.full((k, k), math.inf)
            i, j = _triangle(k)
            m = j - i
            cost = self.family.quick(ts[j], m, *(c[ts[i]] for c in self.columns))
            if self.share is not None:
                cost += self.share[m]
                if self.scale != 1.0:
                    cost *= LOG2E
            inner[i, j] = cost
            full = inner + (least + self.beta)[:, None]
            under = full.min(axis=0)
            hit = np.flatnonzero(under < least)
            while len(hit):
                c = int(hit[0])
                least[c], origin[c] = under[c], ts[full[:, c].argmin()]
                full[c] = inner[c] + (least[c] + self.beta)
                under = np.minimum(under, full[c])
                hit = c + 1 + np.flatnonzero(under[c + 1 :] < least[c + 1 :])
        done = k
        if self.groups:
            bound = self.bounds(ts)
            open_ = bound <= least + 1e-12 * (1 + np.abs(least))
            if open_.any():
                done = int(open_.any(axis=0).argmax())
                which = np.flatnonzero(open_[:, done])
                if done == 0:
                    stale = which[self.table[0][which, 0] < t - 1]
                    if len(stale):
                        self.look(stale, t - 1)
                        return t
                    for g in which:  # looked through for this one row
                        for a in range(0, len(self.groups[g].starts), STEP):
                            some = self.groups[g].starts[a : a + STEP]
                            v = self.values(some, t)
                            first = some[v == v.min()].min()
                            if v.min() < least[0] or v.min() == least[0] and first < origin[0]:
                                least[0], origin[0] = v.min(), first
                    done = 1
            elif self.limit < math.inf:
                gone = np.flatnonzero(bound[:, -1] > least[-1] + self.limit + 1e-9 * (1 + abs(least[-1])))
                if len(gone):
                    self.groups = [g for i, g in enumerate(self.groups) if i not in set(gone.tolist())]
                    self.table = None
        self.rows = min(BLOCK, 2 * self.rows) if done == k else max(4, self.rows // 2)
        best[t : t + done], back[t : t + done] = least[:done], origin[:done]
        last = t + done - 1
        stays = ~self.dropped(self.front, value[:, done - 1], last)
        self.front = np.concatenate((self.front[stays], ts[:done]))
        return last + 1


_triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triangle(k: int) -> tuple[np.ndarray, np.ndarray]:
    if k not in _triangles:
        _triangles[k] = np.triu_indices(k, 1)
    return _triangles[k]


def backpointers(family, p: int, adjustment: str, beta: float, limit: float, best: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Fills `best` and `back` from the second row on; `limit` is what candidates may exceed the least by, infinite if all are kept."""
    n, end = family.n, family.end
    run = _Run(family, p, adjustment, beta, limit, best, back, end)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, full = 2, FRONT
        while t <= end:
            t = run.block(t)
            if len(run.front) > full:
                run.seal(t)
                full = max(FRONT, 2 * len(run.front))
    if end < n:
        # the least cost is -inf from the row after `end` on: by that row alone (and those like it next to it), then by all that follow
        same = family.columns[0][end + 1 :] == family.columns[0][end]
        stop = len(same) if same.all() else int(same.argmin())
        best[end + 1 :] = -math.inf
        back[end + 1 : end + 1 + stop] = end
        back[end + 1 + stop :] = end + 1
    return back
