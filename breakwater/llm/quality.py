"""Quality by compression: sizes under dictionaries built from good and from bad labelled text.

Every text is cut into windows, each compressed with a dictionary of good
text, one of bad text and none. The difference of the first two, divided by
the third, is the normalised difference. It enters a logistic calibration fitted on
the labelled sample, together with the third's share of the text's length
(repetition shows there), the products of the two and the logarithm of the length.

Null and empty texts have no windows and get the calibration's base score.
With a class missing among the labels, every score is the share of good rows
(1 without labels). Repeated rows are scored each; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame

from breakwater.llm import zdict

WINDOW, DICTIONARY, STRETCH = 1024, 98_304, 512
THRESHOLD = 0.7
_HOW = {"strategy": zstd.STRATEGY_DFAST, "min_match": 5, "window_log": 18, "hash_log": 16, "chain_log": 16}


class Model(zdict.Classifier):
    """A classifier of good text (1) and bad text (0)."""

    def features(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.made is None:
            self.made = [zdict.Sizes(x, **_HOW) for x in (self.yes, self.no, None)]
        n, raw = len(bounds) - 1, data.tobytes()
        rows, starts, ends = zdict.windows(bounds, WINDOW, 0)
        good, bad, alone = (np.bincount(rows, m.of(raw, starts, ends), n) for m in self.made)
        some = np.maximum(alone, 1)
        apart, length = (good - bad) / some, np.maximum(np.diff(bounds), 1)
        ratio, own = some / length, np.minimum(good, bad) / some
        apart = np.clip(apart * 5, -4, 4)
        ratio = np.clip(ratio, 0, 1.5)
        empty = (np.diff(bounds) > 0).astype(float)
        return np.column_stack((apart, np.abs(apart), np.maximum(apart, 0) ** 2, ratio * 3, ratio**2 * 3, apart * ratio, own * 3, np.log1p(length) / 8)) * empty[:, None]


def stretches(texts: list[bytes]) -> bytes:
    """Dictionary content: one stretch from each text, at a place that moves along, until the dictionary is full."""
    out, total = [], 0
    for i, t in enumerate(texts):
        if total >= DICTIONARY:
            break
        at = 0 if len(t) <= STRETCH else (i * 7919) % (len(t) - STRETCH)
        out.append(t[at : at + STRETCH])
        total += len(out[-1])
    return b"\n".join(out)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from `labels` (doc_id and `label` 1 or 0) of `docs` (doc_id, text); all given labels may be learnt from."""
    return Model(*zdict.fitted(zdict.sample(docs, labels, label), learn))


def learn(texts: list[bytes], y: np.ndarray, odds: float = 0.0) -> Model:
    """A model from texts and their classes, 1 being good; `odds` are added to the log odds."""
    good, bad = ([t for t, c in zip(texts, y) if c == k] for k in (1, 0))
    if not good or not bad:
        share = (len(good) + 1) / (len(texts) + 1)
        return Model(b"", b"", np.array([0.0] * 8 + [float(np.log(share / (1 - share + 1e-9)))]))
    # every second text goes to the dictionaries, the others to the calibration
    model = Model(stretches(good[::2]), stretches(bad[::2]), np.zeros(1))
    texts = [*(good[1::2] or good), *(bad[1::2] or bad)]
    x = np.concatenate([model.features(data, bounds) for _, _, data, bounds in zdict.texts_in_pieces(texts)])
    n = len(good[1::2] or good)
    model.weights = zdict.logistic(x, np.array([1.0] * n + [0.0] * (len(texts) - n)), 0.3)
    model.weights[-1] += odds
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` without the text and with the score (0 to 1, higher: good likelier) in a new last column."""
    return zdict.score(docs, name, model.scores, text)
