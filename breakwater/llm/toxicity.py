"""Toxicity by compression distance: windows of a text under a dictionary of toxic text and one of ordinary text.

Both dictionaries begin with the same background, trained by zstandard on
windows of ordinary text, so that what both classes share is matched alike.
The rest of each is trained on its own class's texts by the COVER method: segments
that hold the most valuable substrings of eight bytes, a substring's value being
how much commoner it is in this class's texts than in the other's. Every window of
the whole text is compressed with each; how many bytes the toxic dictionary saves is
the window's distance. A text's distances, counted above several thresholds, enter a
logistic calibration. It is fitted on distances from dictionaries that were trained
without the text: each part of the labelled sample is scored by the others'.

Null and empty texts have no windows and get the calibration's base score.
With a class missing among the labels, every score is the share of toxic rows
(0 without labels). Repeated rows are scored each; extra columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame

from breakwater.llm import zdict

WINDOW, LAP = 96, 24
#: Bytes of the shared background and of a class's own part of its dictionary, and what a substring is worth at least if texts are many.
BACKGROUND, OWN, LEAST = 32_768, 4096, 20.0
THRESHOLD = 0.5
#: Parts of the sample, each scored by dictionaries of the others for the calibration.
FOLDS = 8
_STEPS = (1, 2, 3, 4, 5, 6, 8)


class Model(zdict.Classifier):
    """A classifier of toxic text (1) and ordinary text (0)."""

    def features(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.made is None:
            self.made = [zdict.Sizes(x + b"\0" + zdict.KEY, strategy=zstd.STRATEGY_FAST, min_match=7, window_log=18, hash_log=17) for x in (self.no, self.yes)]
        n = len(bounds) - 1
        data, bounds = zdict.marked(data, bounds)
        rows, starts, ends = zdict.windows(bounds, WINDOW, LAP)
        keyed = zdict.keyed(data, starts, ends)
        saved = self.made[0].of(*keyed) - self.made[1].of(*keyed)
        most, least = np.zeros(n), np.zeros(n)
        np.maximum.at(most, rows, saved)
        np.minimum.at(least, rows, saved)
        counts = [np.log1p(np.bincount(rows, saved >= k, n)) for k in _STEPS]
        # an empty text still has the mark before it, which is no window of its own
        some = np.diff(bounds) > len(zdict.MARK)
        return np.column_stack((np.minimum(most, 20) / 4, np.maximum(least, -12) / 4, *counts, np.log1p(np.bincount(rows, minlength=n)) / 4)) * some[:, None]


def trained(texts: list[bytes], y: np.ndarray, seen: np.ndarray, keys: np.ndarray, counts: np.ndarray, shared: bytes) -> Model:
    """A model without weights from the texts that are `seen`; `counts` are frequencies of substrings among them by class, `shared` is the background."""
    toxic, ordinary = ([t for t, c, ok in zip(texts, y, seen) if ok and c == k] for k in (1, 0))
    n, m = max(len(toxic), 1), max(len(ordinary), 1)
    # more texts, more substrings are tried, and the more one of them has to be worth
    least = min(LEAST, 10 + 4 * math.log(max(min(n, m), 10) / 10))
    own = [zdict.cover(of, keys, zdict.surplus(here, a, there, b), OWN, least) for of, here, a, there, b in ((toxic, counts[1], n, counts[0], m), (ordinary, counts[0], m, counts[1], n))]
    return Model(*(b"\0".join((shared, *part)) for part in own), np.zeros(1))


def learn(texts: list[bytes], y: np.ndarray, odds: float = 0.0) -> Model:
    """A model from texts and their classes, 1 being toxic; `odds` are added to the log odds."""
    if not y.any() or y.all():
        share = y.sum() / max(1, len(y))
        return Model(b"", b"", np.array([0.0] * (len(_STEPS) + 3) + [float(np.log((share + 1e-9) / (1 - share + 1e-9)))]))
    # folds hold equal shares of both classes
    fold = np.zeros(len(y), int)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % FOLDS
    keys, counts = zdict.frequencies(texts, 2 * fold + y, 2 * FOLDS)
    counts = counts.reshape(FOLDS, 2, -1)
    shared = zdict.background([t for t, c in zip(texts, y) if not c], BACKGROUND, WINDOW)
    x = np.zeros((len(y), len(_STEPS) + 3))
    for k in range(FOLDS):
        other = trained(texts, y, fold != k, keys, counts.sum(axis=0) - counts[k], shared)
        for low, high, data, bounds in zdict.texts_in_pieces(texts):
            of = fold[low:high] == k
            x[low:high][of] = other.features(data, bounds)[of]
    model = trained(texts, y, np.ones(len(y), bool), keys, counts.sum(axis=0), shared)
    model.weights = zdict.logistic(x, y.astype(float), 0.3)
    model.weights[-1] += odds
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from `labels` (doc_id and `label` 1 or 0) of `docs` (doc_id, text); all given labels may be learnt from."""
    return Model(*zdict.fitted(zdict.sample(docs, labels, label), learn))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` without the text and with the score (0 to 1, higher: toxic likelier) in a new last column."""
    return zdict.score(docs, name, model.scores, text)
