"""Removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

Every byte covered by a string of `LENGTH` bytes that starts at two places of
the input is removed. Instead of all suffixes, those at anchors are indexed: a
window of `LENGTH` bytes has as its anchor the place in it whose next `SEED`
bytes have the least hash, so equal windows have equal anchors, and an anchor
serves all the windows of one stretch.

1. Each text's anchors are found, with the stretch of window starts that an
   anchor serves and a fingerprint of the bytes that those windows cover. Copies
   collapse here: anchors of equal seed and stretch (128 bits together) are
   counted by an aggregation. A stretch that is there twice is repeated as a
   whole, and a seed that is there once repeats nothing.
2. Of the other anchors, and of one example of each repeated stretch of their
   seeds, the bytes themselves are fetched and dealt by seed.
3. There an index family takes them batch by batch. A batch becomes a suffix
   array: its suffixes from the anchors on, sorted by their bytes. While the
   newest two levels are of a size they are merged, and so are all at last; each
   merge scans both arrays side by side for matches of one's suffixes with the
   other's. A match reaches as far right as the common prefix of the two suffixes
   and as far left as the bytes before the anchors agree, byte by byte, and
   counts if both together have `LENGTH` bytes (`matched`).
4. A text's repeated stretches are merged into spans and cut out.

No text is compared with another one, no group of copies is paired, and what
a task holds is a bounded number of anchors, but for a seed that stands in more
than `HOT` different stretches: the windows of such a seed are dealt singly and
counted by an aggregation of their fingerprints instead. Null texts count as
empty; a text shorter than `LENGTH` keeps all bytes. Rows that repeat wholly are
copies of one another; rows that share a doc_id are told apart by their text. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakwater.llm.arrays import cut, pieces, prefix_hashes, releasing, span_hashes, text_bytes, window_hashes
from breakwater.llm.shared import parts, saved, small

LENGTH, SEED = 400, 32
#: Anchors of a task of the index family, and of a seed that is still one task's.
ANCHORS, HOT = 20_000, 50_000
_PLACE = np.uint64((1 << 24) - 1)
_CHUNK = 1 << 22


def shared_bytes(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7 >> 3)


def matched(group: list[tuple[bytes, bytes, int]], length: int, left: list[int], right: list[int]) -> None:
    """Raises `left` and `right`, the bytes before and after an anchor that a match covers, for each anchor of a seed.

    `group` holds (suffix, bytes before the anchor in reverse, number), sorted. Two
    suffixes agree as far as the least common prefix of neighbours between them, so
    joining neighbours in falling order of that makes growing sets whose members agree
    with one another in so many bytes at least. A set keeps the bytes before its anchors
    sorted; when two sets join, each member of the smaller one looks for its two
    neighbours in the larger, which are those with the longest agreement. A member
    that is no such neighbour has one nearer to it in its own set, with which it agrees
    no less on either side. So this takes n log n steps, not a step for each pair.
    """
    common = [shared_bytes(a[0], b[0]) for a, b in zip(group, group[1:])]
    sets: list[list[tuple[bytes, int]]] = [[(before, k)] for _, before, k in group]
    first, last = list(range(len(group))), list(range(len(group)))  # a set is named at both its ends
    for i in sorted(range(len(common)), key=lambda i: -common[i]):
        low, high = first[i], last[i + 1]
        one, other = sets[i], sets[i + 1]
        if len(one) > len(other):
            one, other = other, one
        reach = common[i]
        for before, k in one:
            at = bisect_left(other, (before, k))
            for near in other[max(at - 1, 0) : at + 1]:
                back = shared_bytes(before, near[0])
                if back + reach >= length:
                    for j in (k, near[1]):
                        left[j], right[j] = max(left[j], back), max(right[j], reach)
        for x in one:
            insort(other, x)
        first[high], last[low] = low, high
        sets[low] = sets[high] = other  # only a set's ends are asked for again


class Family:
    """Sorted suffix arrays whose sizes fall by a half at least; merging two of them finds the matches between them."""

    def __init__(self, length: int, seed: int) -> None:
        self.length, self.seed = length, seed
        self.levels: list[list[tuple[bytes, bytes, int]]] = []
        self.left: list[int] = []
        self.right: list[int] = []

    def add(self, suffixes: list[tuple[bytes, bytes]]) -> None:
        """Takes a batch of suffixes and the bytes before them in reverse; they are numbered on."""
        if not suffixes:
            return
        begin = len(self.left)
        self.left += [0] * len(suffixes)
        self.right += [0] * len(suffixes)
        level = sorted((suffix, before, begin + k) for k, (suffix, before) in enumerate(suffixes))
        self._scan(level)
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = self._merged(self.levels.pop(), level)
        self.levels.append(level)

    def whole(self) -> None:
        """Merges all levels, so that every suffix has met every other one."""
        while len(self.levels) > 1:
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))

    def _merged(self, a: list[tuple[bytes, bytes, int]], b: list[tuple[bytes, bytes, int]]) -> list[tuple[bytes, bytes, int]]:
        level = sorted(a + b)  # a merge of two runs
        self._scan(level, {k for _, _, k in min(a, b, key=len)})
        return level

    def _scan(self, level: list[tuple[bytes, bytes, int]], some: set[int] | None = None) -> None:
        """Matches of each seed's suffixes; given `some`, only of seeds that have both them and others."""
        for _, group in groupby(level, lambda x: x[0][: self.seed]):
            group = list(group)
            if len(group) > 1 and (some is None or 0 < sum(k in some for _, _, k in group) < len(group)):
                matched(group, self.length, self.left, self.right)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = values
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor, first window, last window, seed hash, stretch hash), places counted from the row's start."""
    for base in range(0, max(len(data) - length + 1, 0), _CHUNK):
        part = data[base : base + _CHUNK + length - 1]
        sums = prefix_hashes(part)
        h = window_hashes(sums, seed)
        best = least(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), length - seed + 1)
        place = (best & _PLACE).astype(np.int64)
        at = np.arange(base, base + len(place))
        rows = np.searchsorted(bounds, at, "right") - 1
        good = at + length <= bounds[rows + 1]
        at, rows, place = at[good], rows[good], place[good] + base
        if not len(at):
            continue
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        rows, place, lo, hi = rows[first], place[first], at[first], at[last]
        yield rows, place - bounds[rows], lo - bounds[rows], hi - bounds[rows], h[place - base], span_hashes(sums, lo - base, hi + length - base)


def _anchored(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, part, lo, at, one, hi, seed, stretch, n): anchors, `at` being their place; equal ones in a row are one, with n = 2."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, bounds in pieces(batch.column(2)):
                for rows, place, lo, hi, s, e in anchors(data, bounds, length, seed):
                    # a periodic text has the same anchor again and again
                    new = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (rows[1:] != rows[:-1])))
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(s)) - 1
                    take = pa.array(rows[first] + row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(take),
                            batch.column(1).take(take),
                            pa.array(lo[first].astype(np.int32)),
                            pa.array(place[first].astype(np.int32)),
                            pa.array(hi[first].astype(np.int32)),
                            pa.array(hi[last].astype(np.int32)),
                            pa.array(s[first].view(np.int64)),
                            pa.array(e[first].view(np.int64)),
                            pa.array(np.where(last > first, 2, 1)),
                        ],
                        ["doc_id", "part", "lo", "at", "one", "hi", "seed", "stretch", "n"],
                    )

    return docs.mapInArrow(releasing(run), f"doc_id {kind}, part long, lo int, at int, one int, hi int, seed long, stretch long, n long")


def _verdicts(entries: DataFrame) -> DataFrame:
    """(seed, stretch, whole, mixed, stretches) of (seed, stretch, n): seeds that occur twice at least.

    whole: this stretch occurs twice; mixed: the seed also has stretches that do not; stretches: how many the seed has.
    """
    summed = entries.groupBy("seed", "stretch").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("seed")
    summed = summed.withColumns({"total": F.sum("n").over(of), "least": F.min("n").over(of), "stretches": F.count(F.lit(1)).over(of)})
    return summed.where("total > 1").select("seed", "stretch", (F.col("n") > 1).alias("whole"), (F.col("least") < 2).alias("mixed"), "stretches")


def _fetched(asked: DataFrame, length: int) -> DataFrame:
    """(doc_id, part, seed, hot, lo, at, judged, bytes) of (doc_id, part, text, wants): the bytes that an anchor's windows cover."""
    kind = dict(asked.dtypes)["doc_id"]
    names = ["doc_id", "part", "seed", "hot", "lo", "at", "judged", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                some = batch.slice(row, 64)
                data, bounds = text_bytes(some.column(2))
                wants = some.column(3)
                owner = np.repeat(np.arange(some.num_rows), np.diff(wants.offsets.to_numpy()))
                flat = wants.flatten()
                lo, one = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "one"))
                raw = data.tobytes()
                begin = bounds[owner] + lo
                got = pa.array([raw[a:b] for a, b in zip(begin.tolist(), (begin + one - lo + length).tolist())], pa.binary())
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(1).take(take), *(flat.field(k) for k in names[2:7]), got], names)

    return asked.mapInArrow(releasing(run), f"doc_id {kind}, part long, seed long, hot boolean, lo int, at int, judged boolean, bytes binary")


def _indexed(fetched: DataFrame, length: int, seed: int, shards: int) -> DataFrame:
    """(doc_id, part, a, b): what matches cover around the anchors to be judged."""
    kind = dict(fetched.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held = Family(length, seed), []
        for batch in batches:
            off = (batch.column("at").to_numpy() - batch.column("lo").to_numpy()).tolist()
            family.add([(x[k:], x[:k][::-1]) for x, k in zip(batch.column("bytes").to_pylist(), off)])
            held.append(batch.select(["doc_id", "part", "at", "judged"]))
        family.whole()
        low = 0
        for batch in held:
            left, right = (np.array(x[low : low + batch.num_rows], np.int32) for x in (family.left, family.right))
            low += batch.num_rows
            found = np.flatnonzero((right > 0) & batch.column("judged").to_numpy(zero_copy_only=False))
            at, take = batch.column("at").to_numpy()[found], pa.array(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at - left[found]), pa.array(at + right[found])], ["doc_id", "part", "a", "b"])

    return fetched.select("doc_id", "part", "seed", "lo", "at", "judged", "bytes").repartition(shards, "seed").mapInArrow(releasing(run), f"doc_id {kind}, part long, a int, b int")


def _counted(fetched: DataFrame, length: int) -> DataFrame:
    """(doc_id, part, a, b): repeated windows of hot seeds' anchors, by an aggregation of all their windows' fingerprints."""
    kind = dict(fetched.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("bytes")
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            for row, _, data, bounds in cut(raw, ends - ends[0], 1 << 16):
                sums = prefix_hashes(data)
                at = np.arange(len(data) - length + 1)
                rows = np.searchsorted(bounds, at, "right") - 1
                good = at + length <= bounds[rows + 1]
                at, rows = at[good], rows[good]
                take = pa.array(rows + row)
                lo = batch.column("lo").take(take).to_numpy() + (at - bounds[rows])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("doc_id", "part", "seed", "judged")), pa.array(lo.astype(np.int32)), pa.array(span_hashes(sums, at, at + length).view(np.int64))], ["doc_id", "part", "seed", "judged", "a", "h"])

    every = saved(fetched.select("doc_id", "part", "seed", "lo", "judged", "bytes").mapInArrow(releasing(run), f"doc_id {kind}, part long, seed long, judged boolean, a int, h long"))
    twice = every.groupBy("seed", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed", "h")
    return every.where("judged").join(twice, ["seed", "h"]).select("doc_id", "part", "a", (F.col("a") + length).alias("b"))


def spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, part, spans): the texts with repeated strings; spans may touch and overlap. docs: doc_id, part, text."""
    found = saved(_anchored(docs, length, seed))
    verdicts = _verdicts(found.select("seed", "stretch", "n"))
    judged = saved(found.join(verdicts, ["seed", "stretch"]).drop("n"))
    whole = judged.where("whole").select("doc_id", "part", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    # one example of a repeated stretch is enough for the others of its seed
    example = judged.where("whole and mixed").groupBy("seed", "stretch").agg(F.min(F.struct("doc_id", "part", "lo", "at", "one", "stretches")).alias("x"))
    hot = lambda c: (F.col(c) > HOT).alias("hot")
    want = judged.where("not whole").select("doc_id", "part", F.struct("seed", hot("stretches"), "lo", "at", "one", F.lit(True).alias("judged")).alias("want"))
    want = want.union(example.select("x.doc_id", "x.part", F.struct("seed", hot("x.stretches"), "x.lo", "x.at", "x.one", F.lit(False).alias("judged"))))
    want = saved(want.groupBy("doc_id", "part").agg(F.collect_list("want").alias("wants")))
    sizes = want.agg(F.sum(F.size("wants")).alias("n"), F.max(F.exists("wants", lambda w: w["hot"])).alias("hot")).first()
    asked = _with_texts(docs, want, "wants")
    fetched = _fetched(asked.select("doc_id", "part", "text", "wants"), length)
    shards = max(parts(docs.sparkSession), math.ceil((sizes["n"] or 0) / ANCHORS))
    every = whole
    if sizes["hot"]:
        fetched = saved(fetched)
        every = every.union(_counted(fetched.where("hot"), length))
    every = every.union(_indexed(fetched.where("not hot"), length, seed, shards))
    return saved(every.groupBy("doc_id", "part").agg(F.collect_list(F.struct("a", "b")).alias("spans")))


def _with_texts(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` (doc_id, part, ...) with the text, once for each (doc_id, part)."""
    ids = rows.select(F.col("doc_id").alias("i"), F.col("part").alias("p"))
    on = lambda x, y: x["doc_id"].eqNullSafe(y["i"]) & (x["part"] == y["p"])
    few = docs.join(small(ids, rows.count()), on(docs, ids), "left_semi").dropDuplicates(["doc_id", "part"])
    other = rows.select(F.col("doc_id").alias("i"), F.col("part").alias("p"), *columns)
    return few.join(other, on(few, other)).drop("i", "p")


def remove_repeats(docs: DataFrame, text: str = "text", id_: str = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: kept is what is left of the text's bytes."""
    if not 8 <= seed < length:
        raise ValueError("a seed of 8 bytes or more, shorter than the length, is needed")
    named = docs.select(F.col(id_).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    kind = dict(named.dtypes)["doc_id"]
    marks = spans(named, length, seed)
    count = marks.count()
    ids = marks.select(F.col("doc_id").alias("i"), F.col("part").alias("p"))
    on = named["doc_id"].eqNullSafe(ids["i"]) & (named["part"] == ids["p"])
    zero = F.lit(0).cast("long")
    untouched = named.join(small(ids, count), on, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    other = marks.select(F.col("doc_id").alias("i"), F.col("part").alias("p"), "spans")
    touched = named.join(small(ids, count), on, "left_semi")
    touched = touched.join(other, touched["doc_id"].eqNullSafe(other["i"]) & (touched["part"] == other["p"])).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                some = batch.slice(row, 256)
                data, bounds = text_bytes(some.column(1))
                owner = np.repeat(np.arange(some.num_rows), np.diff(some.column(2).offsets.to_numpy()))
                flat = some.column(2).flatten()
                edges = np.zeros(len(data) + 1, np.int32)
                for k, step in (("a", 1), ("b", -1)):
                    np.add.at(edges, bounds[owner] + flat.field(k).to_numpy(zero_copy_only=False), step)
                gone = np.cumsum(edges)[:-1] > 0
                begins = gone & ~np.concatenate(([False], gone[:-1]))
                begins[bounds[:-1][bounds[:-1] < len(data)]] = gone[bounds[:-1][bounds[:-1] < len(data)]]
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])
                n, removed = np.diff(bounds), total(gone)
                ends = np.concatenate(([0], np.cumsum(n - removed))).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[~gone].tobytes())])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), pa.array(removed), pa.array(total(begins)), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return untouched.union(touched.mapInArrow(releasing(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))
