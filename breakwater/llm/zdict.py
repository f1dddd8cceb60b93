"""Classification by zstandard dictionaries: how much shorter a text gets with one class's dictionary than with another's.

Two classifiers share this module's parts. Both learn from a bounded sample of
labelled rows (`SAMPLE_ROWS` rows a class, of at most `SAMPLE_CHARS`
characters each, those with the least hash of the id). One task learns from
it, piece by piece, and the driver receives the model; scoring runs over whole
texts on the executors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breakwater.llm.arrays import _LOWER, _SPACE, pieces, prefix_hashes, releasing, window_hashes
from breakwater.llm.shared import small_batches

#: Bounds of the labelled sample that a classifier is fitted on.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 12_000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(y, h, doc_id, text, labelled) of at most `rows` labelled rows of each class.

    Contradicting or repeated labels of a document count once each; null
    labels, null texts and labels other than 0 and 1 are left out. `labelled` is
    the number of the class's labelled documents.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").distinct()
    # ids are drawn first, so that only the drawn rows' texts travel
    there = docs.where(F.length("text") <= chars).select("doc_id").distinct()
    there = marks.join(there, "doc_id").withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(7)))
    some = None
    for y in (0, 1):
        drawn = there.where(F.col("y") == y).orderBy("h", "doc_id").limit(rows)
        part = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(drawn), "doc_id")
        part = part.select("y", "h", F.col("doc_id").cast("string").alias("doc_id"), "text").orderBy("h", "doc_id", "text").limit(rows)
        some = part if some is None else some.union(part)
    # what share of its class's labelled documents a row stands for; a row for each class, so a broadcast of them is small
    shares = there.groupBy("y").agg(F.count(F.lit(1)).alias("labelled"))
    return some.join(F.broadcast(shares), "y")


class Classifier:
    """The dictionaries of class 1 and of class 0, and a calibration's weights; picklable, compressors are made where it runs."""

    def __init__(self, yes: bytes, no: bytes, weights: np.ndarray):
        self.yes, self.no, self.weights = yes, no, weights
        self.made = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "made": None}

    def features(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x = self.features(data, bounds)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fitted(some: DataFrame, learn: Callable[[list[bytes], np.ndarray, float], Classifier]) -> tuple[bytes, bytes, np.ndarray]:
    """What `learn` makes of a `sample`, in one task; the driver receives the dictionaries and weights alone.

    `learn` takes the texts, their classes, and how much the log odds of class 1
    among all labelled documents exceed those in the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("y", "h", "doc_id", "text", "labelled"))))
        y = np.array([r[0] for r in rows], int)
        per_row = {k: next((r[4] for r in rows if r[0] == k), 0) / max(1, int((y == k).sum())) for k in (0, 1)}
        odds = math.log(per_row[1] / per_row[0]) if all(per_row.values()) else 0.0
        model = learn([r[3].encode() for r in rows], y, odds)
        yield pa.RecordBatch.from_arrays([pa.array([model.yes], pa.binary()), pa.array([model.no], pa.binary()), pa.array([model.weights.tolist()])], ["yes", "no", "weights"])

    with small_batches(some.sparkSession):
        got = some.coalesce(1).mapInArrow(releasing(run), "yes binary, no binary, weights array<double>").first()
    if got is None:  # an empty sample may have no partition
        none = learn([], np.zeros(0, int), 0.0)
        return none.yes, none.no, none.weights
    return bytes(got[0]), bytes(got[1]), np.array(got[2])


def texts_in_pieces(texts: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """`pieces` of a list of texts, joined piece by piece."""
    sizes = np.array([len(t) for t in texts])
    low = 0
    while low < len(texts):
        high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), size, "right")))
        yield low, high, np.frombuffer(b"".join(texts[low:high]), np.uint8), np.concatenate(([0], np.cumsum(sizes[low:high])))
        low = high


class Sizes:
    """Compressed sizes of many windows with one raw dictionary (None: without one)."""

    def __init__(self, content: bytes | None, **how: int):
        kept = {"dict_data": zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)} if content else {}
        plan = zstd.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, **how)
        self.compressor = zstd.ZstdCompressor(compression_params=plan, **kept)

    def of(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        spans = np.stack((starts, ends - starts), axis=1).astype(np.uint64)
        got = self.compressor.multi_compress_to_buffer(zstd.BufferWithSegments(data, spans.tobytes()), threads=1)
        return np.fromiter(map(len, map(got.__getitem__, range(len(got)))), np.int64, len(got))


#: What stands for white space, and before a text, in windows: long enough that a match has to begin with a word.
MARK = b"\x01\x02\x03"


def marked(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z) with `MARK` for each white-space byte and before each text, and the bounds thereof."""
    space = _SPACE[data]
    size = np.where(space, len(MARK), 1)
    texts = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    before = np.cumsum(size) - size + len(MARK) * (texts + 1)
    ends = np.concatenate(([0], np.cumsum(size)))[bounds] + len(MARK) * np.arange(len(bounds))
    out = np.zeros(int(ends[-1]), np.uint8)
    out[before] = _LOWER[data]
    for k, b in enumerate(MARK):
        out[before[space] + k] = b
        out[ends[:-1] + k] = b
    return out, ends


def windows(bounds: np.ndarray, width: int, lap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of windows of `width` bytes, each going on `lap` bytes into the next; an empty text has none."""
    n = np.diff(bounds)
    count = -(-n // width)
    rows = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    starts = bounds[rows] + k * width
    return rows, starts, np.minimum(starts + width + lap, bounds[rows + 1])


#: Begins every window and ends every dictionary, so that no window is stored raw and sizes differ by whole matches.
KEY = b"\x05\x06\x07\x08\x0b\x0c\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17"


def keyed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Copies of the windows one after another, each behind `KEY`: bytes, starts and ends."""
    n, k = ends - starts, len(KEY)
    to = np.cumsum(n + k)
    begin = to - n - k
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint8)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(begin + k, n) + at] = data[np.repeat(starts, n) + at]
    out[(begin[:, None] + np.arange(k)).ravel()] = np.tile(np.frombuffer(KEY, np.uint8), len(starts))
    return out.tobytes(), begin, to


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last one is the intercept. Columns of `x` are of unit scale."""
    x = np.column_stack((x, np.ones(len(x))))
    w, pull = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    pull[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


#: A substring that a dictionary is made for has `_UNIT` bytes; one that fewer than `_TEXTS` texts hold has no value.
_UNIT, _TEXTS = 8, 3
#: Hashes are sorted in so many shares by their range.
_ROUGH, _SHARES = 25, 8


def _units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each substring of `_UNIT` bytes, its text, and whether it stands within one text."""
    h = window_hashes(prefix_hashes(data), _UNIT) & ~np.uint64(15)  # room for a group
    at = np.arange(len(h))
    rows = np.searchsorted(bounds, at, "right") - 1
    return h, rows, at + _UNIT <= bounds[rows + 1]


def _once(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and hash of each text's distinct substrings, sorted by hash, piece by piece."""
    for low, _, data, bounds in texts_in_pieces(texts):
        h, rows, whole = _units(*marked(data, bounds))
        h, rows = h[whole], rows[whole]
        order = np.argsort(h, kind="stable")  # rows stay in order among equals
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        yield rows[new] + low, h[new]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def frequencies(texts: list[bytes], group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the substrings that `_TEXTS` texts hold at least, and in how many texts of each group (at most 16).

    A table of small counters tells first which substrings may be that
    frequent, so that the others' hashes are never held together.
    """
    rough = np.zeros(1 << _ROUGH, np.uint8)
    shift, low = np.uint64(64 - _ROUGH), np.uint64(15)
    for _, h in _once(texts):
        at = h >> shift
        first = _starts(at)
        rough[at[first]] = np.minimum(rough[at[first]].astype(int) + np.diff(np.append(first, len(at))), 255)
    shares: list[list[np.ndarray]] = [[] for _ in range(_SHARES)]
    edges = np.array([(k << 64) // _SHARES for k in range(1, _SHARES)], np.uint64)
    for rows, h in _once(texts):
        some = rough[h >> shift] >= _TEXTS
        h, rows = h[some], rows[some]
        for share, part in zip(shares, np.split(h & ~low | group[rows].astype(np.uint64), np.searchsorted(h, edges))):
            share.append(part)  # the group in the last bits
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros((groups, 0), np.int32)]
    for share in shares:
        every = np.concatenate((np.zeros(0, np.uint64), *share))
        share.clear()
        every.sort()
        first = _starts(every & ~low)
        often = np.diff(np.append(first, len(every))) >= _TEXTS
        if often.any():
            of = (every & low).astype(np.int8)
            keys.append((every[first] & ~low)[often])
            counts.append(np.array([np.add.reduceat(of == g, first, dtype=np.int32)[often] for g in range(groups)]))
    return np.concatenate(keys), np.concatenate(counts, axis=1)


def surplus(here: np.ndarray, n: int, there: np.ndarray, m: int) -> np.ndarray:
    """Log-likelihood ratio of each substring's shares of n texts here and m there; 0 where it is not commoner here."""
    out = np.zeros(len(here))
    some = np.flatnonzero(here >= _TEXTS)
    some = some[here[some].astype(float) * m > there[some].astype(float) * n]
    c, d = here[some].astype(float), there[some].astype(float)
    p = (c + d) / (n + m)
    out[some] = 2 * (c * np.log(c / (n * p)) + np.where(d > 0, d * np.log(np.maximum(d, 1) / (m * p)), 0))
    return out


def _candidates(texts: list[bytes], keys: np.ndarray, value: np.ndarray, segment: int) -> list[tuple[np.ndarray, bytes]]:
    """For each of the substrings `keys` the segment of the texts that begins with it and is worth most: its substrings' places, its bytes."""
    span = segment - _UNIT + 1
    best: dict[int, tuple[float, np.ndarray, bytes]] = {}
    for _, _, data, bounds in texts_in_pieces(texts):
        data, bounds = marked(data, bounds)
        h, _, whole = _units(data, bounds)
        place = np.searchsorted(keys, h)
        place[(np.append(keys, np.uint64(0))[place] != h) | ~whole] = len(keys)
        total = np.concatenate(([0.0], np.cumsum(np.append(value, 0.0)[place])))
        scores = total[span:] - total[:-span]
        some = np.flatnonzero(place[: len(scores)] < len(keys))
        some = some[np.argsort(-scores[some], kind="stable")]
        for i in some[np.unique(place[some], return_index=True)[1]].tolist():
            k = int(place[i])
            if k not in best or best[k][0] < scores[i]:
                best[k] = float(scores[i]), place[i : i + span], data[i : i + segment].tobytes()
    return [x[1:] for x in best.values()]


def cover(texts: list[bytes], keys: np.ndarray, value: np.ndarray, size: int, least: float, segment: int = 16, floor: int = 128) -> list[bytes]:
    """Segments of the texts that cover the most valuable substrings (`keys`, sorted): a dictionary's content, the best last.

    As in zstandard's COVER trainer a segment is worth the sum of its distinct
    substrings that no chosen one holds, and loses the ends that hold none. Only
    values of `least` or more count, unless less than `floor` bytes were chosen:
    then the thousand next ones do.
    """
    out, total = [], 0
    enough = value >= least
    rest = np.sort(value[~enough & (value > 0)])[-1000:]
    for some, most in ((enough, size), (~enough & (value >= (rest[0] if len(rest) else np.inf)), floor)):
        if total >= most or not some.any():
            continue
        kept = _candidates(texts, keys[some], value[some], segment)
        left = np.append(value[some], 0.0)
        heap = [(-float(left[np.unique(ids)].sum()), i) for i, (ids, _) in enumerate(kept)]
        heapq.heapify(heap)
        while heap and total < most:
            _, i = heapq.heappop(heap)
            ids, raw = kept[i]
            now = float(left[np.unique(ids)].sum())
            if now <= 0:
                continue
            if heap and now < -heap[0][0]:
                heapq.heappush(heap, (-now, i))
                continue
            at = np.flatnonzero(left[ids] > 0)
            out.append((now, raw[at[0] : at[-1] + _UNIT]))
            total += len(out[-1][1])
            left[ids] = 0
    return [x for _, x in sorted(out)]


def background(texts: list[bytes], size: int, window: int, most: int = 2 << 20) -> bytes:
    """A dictionary trained by zstandard on windows of the texts, evenly drawn, of about `most` bytes."""
    step, out, k = max(1, -(-sum(map(len, texts)) // most)), [], 0
    for _, _, data, bounds in texts_in_pieces(texts):
        data, bounds = marked(data, bounds)
        raw, (_, starts, ends) = data.tobytes(), windows(bounds, window, 0)
        for a, b in zip(starts.tolist(), ends.tolist()):
            if k % step == 0:
                out.append(raw[a:b])
            k += 1
    try:
        return zstd.train_dictionary(size, out, k=32, d=_UNIT).as_bytes()
    except zstd.ZstdError:  # too little text to train on
        return b"".join(out)[-size:]


def score(docs: DataFrame, name: str, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], text: str = "text") -> DataFrame:
    """`docs` without the text and with a double column `name`; `scorer` takes bytes and bounds of some texts."""
    names = [c for c in docs.columns if c != text]
    if name in names:
        raise ValueError(f"a column {name} exists; name another one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, bounds in pieces(batch.column(len(names))):
                out = pa.array(np.asarray(scorer(data, bounds), float), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(row, to - row) for i in range(len(names))] + [out], [*names, name])

    return docs.select(*names, text).mapInArrow(releasing(run), T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField(name, T.DoubleType())]))
