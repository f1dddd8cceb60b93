"""Similarity join on word shingles: size-banded tiles, parity bitmaps, exact intersection.

A document is the set of its distinct shingles. Two sets of sizes a and b can
reach the similarity s only if they differ in at most d = (a+b)(1-s)/(1+s)
shingles, which has several uses.

0. Probes. Of a set of n shingles at most n - ceil(s n) are missing in a partner.
   So of its n - ceil(s n) + 1 + n // `EXTRA` least shingles by hash, more than
   ceil(s n) // `EXTRA` are probes of the partner, too. Sets of which fewer
   probes occur in other sets have no partner and go no further.
1. Candidates. Sizes fall into bands. A band fixes a number k of parts, larger
   than the d of any two of its sets, and every shingle belongs to one part by
   its hash. With k = d + 1 + 2m, sets that differ in at most d shingles agree
   on more than 2m parts, so a hash of each part's content is a key that finds
   every pair. A set belongs to the band of its own size and to any band below
   that its possible partners can have. Parts without shingles have keys only
   in sets with more than m of them. So a set of e empty parts needs 2m + 1 - e
   keys in common with a partner (m + 1 if its empty parts have keys), and a
   pair as many as the needier of the two. Sets that meet others in fewer keys
   of a band than they need leave it.
2. Agreement. Keys of at most `COMMON` sets are rare, the others common, and h is
   a set's need times `HEAVY`. A pair shares fewer than h common keys, or at least
   h of them (h of the needier set). If fewer, it shares the rest of its need in rare keys: pairs
   are counted over these, of at most `COMMON` sets each, and enough of them
   make a link. If more, then the first common key that both have, in one order by
   number of sets, is among the first c - h + 1 of the c common keys of
   either: sets hang on these (as many rows as keys, never a common group's pairs).
   A passage that many texts share thus connects nothing, while a large group of
   near copies still meets in its own keys.
3. Bounds. Sets of equal content are one. The components of those links are
   blocks. A set has a bitmap in which every shingle toggles one bit. The bits in
   which two bitmaps differ are at most the shingles in which the sets differ:
   more than d, and the pair cannot link. Blocks of more than `TILE` sets are first
   split into the components of what the bitmaps alone, of an eighth of a
   set's bytes or less, leave possible.
4. Tiles. A block that is still larger is dealt into tiles: neighbouring size
   bands, where these are large pairs of their chunks. What the bitmaps leave in a
   tile, and is not connected yet, is decided by the intersection of sorted arrays.

Linked sets' components are then the documents' classes.

Null and empty texts, and texts of white space only, have no shingles and link
with nothing. A text of fewer words than a shingle's width has one shingle, all
its words. Rows with a null doc_id take part; a class of such rows alone has a
null id. Repeated rows link with one another. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakwater.llm.arrays import mix, pieces, release, releasing, shingles, words
from breakwater.llm.shared import BATCH_BYTES, components, saved, small

#: Sets, and shingles of them together, that a tile's chunk holds about.
TILE, ELEMENTS = 2000, 1 << 20
#: The same of bitmaps, which from a similarity of 0.7 on have less than a byte a shingle.
SKETCHES, SKETCH_BYTES = 16_000, 16 << 20
#: Ratio of a band's largest size to its smallest.
BAND = 1.25
#: Keys of more sets than this are common; the pairs that meet in the others are counted.
COMMON = 40
#: Common keys, in proportion to what it needs, from which on a set hangs on them.
HEAVY = Fraction(9, 10)
#: One shingle in so many is probed beyond the necessary ones; a passage of less than about this share finds no partner.
EXTRA = 24
#: The low bits of a key that tell its band.
_BAND_BITS = 7


class Measure:
    """Whole-number arithmetic for a similarity of `percent` hundredths."""

    def __init__(self, percent: int, width: int):
        if not 50 <= percent <= 100:
            raise ValueError("a similarity from 0.5 to 1 is needed")
        self.percent, self.width = percent, width
        edges, size = [1], 1
        while len(edges) < 120:
            size = max(size + 1, math.ceil(size * BAND))
            edges.append(size)
        self.edges = np.array(edges, np.int64)

    def apart(self, total):
        """Most shingles in which sets of `total` shingles together may differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)

    def band(self, size):
        return np.searchsorted(self.edges, size, "right") - 1

    def bits(self, size: int) -> int:
        """Bits of a parity bitmap that tell sets of up to `size` shingles apart."""
        return 1 << max(9, int(4 * self.apart(2 * size)).bit_length())

    def parts(self, band: int) -> tuple[int, int]:
        """k and m of a band: its smaller sets are below its upper edge, their partners below that over the similarity."""
        upper = int(self.edges[band + 1]) - 1
        d = int(self.apart(upper + upper * 100 // self.percent))
        if not d:
            return 1, 0
        m = 1
        for _ in range(30):
            k = d + 1 + 2 * m
            empty = k * math.exp(-int(self.edges[band]) / k)
            m = min(d, max(m, math.ceil(empty + 3 * math.sqrt(empty)), 1 + k // 24))
        return d + 1 + 2 * m, m


def _keys(measure: Measure, rows: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and key of every part of every band that the sets belong to, and how many keys of that band a partner shares at least."""
    out_rows, out_keys, out_need = [], [], []
    low = measure.band(-(-sizes * measure.percent // 100))
    high = measure.band(np.maximum(sizes, 1))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for band in range(int(low[sizes > 0].min()), int(high.max()) + 1) if (sizes > 0).any() else ():
        of = np.flatnonzero((sizes > 0) & (low <= band) & (band <= high))
        if not len(of):
            continue
        k, spare = measure.parts(band)
        n = sizes[of]
        at = np.repeat(begin[of], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        part = (mix(h[at] + np.uint64(band)) >> np.uint64(20)) % np.uint64(k)
        slot = np.repeat(np.arange(len(of)), n) * k + part.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, content = slot[order], mix(h[at][order])
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        sums = np.add.reduceat(content, first)
        slot = slot[first]
        own, part = slot // k, (slot % k).astype(np.uint64)
        empty = k - np.bincount(own, minlength=len(of))
        need = np.where(empty > spare, spare + 1, 2 * spare + 1 - empty).astype(np.int32)
        salt, low_bits = np.uint64(band) << np.uint64(32), np.uint64((1 << _BAND_BITS) - 1)
        out_rows.append(of[own])
        out_keys.append(mix(sums ^ mix(part + salt)) & ~low_bits | np.uint64(band))
        out_need.append(need[own])
        for j in np.flatnonzero(empty > spare).tolist():
            none = np.setdiff1d(np.arange(k, dtype=np.uint64), part[own == j])
            out_rows.append(np.full(len(none), of[j]))
            out_keys.append(mix(mix(none + salt) + np.uint64(1)) & ~low_bits | np.uint64(band))
            out_need.append(np.full(len(none), need[j]))
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(out_rows), np.concatenate(out_keys), np.concatenate(out_need)


def _digests(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit digest of each row's set."""
    sizes = np.bincount(rows, minlength=n)
    ends = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5)))))
    to = np.cumsum(sizes)
    return sizes, mix(ends[to] - ends[to - sizes] + mix(sizes.astype(np.uint64))).view(np.int64)


def signatures(docs: DataFrame, measure: Measure, text: str, id_: str) -> DataFrame:
    """(doc_id, n_shingles, digest, probes) of each document; digest is null without shingles."""
    kind = dict(docs.dtypes)[id_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, bounds in pieces(batch.column(1)):
                n = to - row
                at, _, _, h = words(data, bounds)
                at, h = shingles(at, h, n, measure.width)
                sizes, digest = _digests(at, h, n)
                ends = np.cumsum(sizes)
                most = sizes - (sizes * measure.percent + 99) // 100 + 1 + sizes // EXTRA
                probed = np.arange(len(h)) - np.repeat(ends - sizes, sizes) < np.repeat(most, sizes)
                to_ = np.concatenate(([0], np.cumsum(np.bincount(at[probed], minlength=n))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(sizes, pa.int64()), pa.array(digest, mask=sizes == 0), pa.ListArray.from_arrays(pa.array(to_, pa.int32()), pa.array(h[probed].view(np.int64)))],
                    ["doc_id", "n_shingles", "digest", "probes"],
                )

    return docs.select(id_, text).mapInArrow(releasing(run), f"doc_id {kind}, n_shingles long, digest long, probes array<long>")


def _part_keys(docs: DataFrame, measure: Measure) -> DataFrame:
    """(digest, key, need) of (digest, text): the keys of every set's parts, and the number that a partner shares at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, bounds in pieces(batch.column(1)):
                at, _, _, h = words(data, bounds)
                at, h = shingles(at, h, to - row, measure.width)
                sizes, digest = _digests(at, h, to - row)
                rows, keys, need = _keys(measure, at, h, sizes)
                good = digest[rows] == batch.column(0).slice(row, to - row).to_numpy()[rows]  # another text of the same doc_id is another set
                rows, keys, need = rows[good], keys[good], need[good]
                for k in range(0, len(rows), 1 << 16):
                    cut = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(digest[rows[cut]]), pa.array(keys[cut].view(np.int64)), pa.array(need[cut], pa.int32())], ["digest", "key", "need"])

    return docs.select("digest", "text").mapInArrow(releasing(run), "digest long, key long, need int")


def _sets(docs: DataFrame, measure: Measure) -> DataFrame:
    """(digest, block, elements) of (digest, block, text): elements are sorted 64-bit hashes as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, bounds in pieces(batch.column(2)):
                at, _, _, h = words(data, bounds)
                at, h = shingles(at, h, to - row, measure.width)
                sizes, digest = _digests(at, h, to - row)
                ends = np.concatenate(([0], np.cumsum(sizes))) * 8
                raw = pa.Array.from_buffers(pa.binary(), to - row, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(h.tobytes())])
                own = batch.column(0).slice(row, to - row)
                out = pa.RecordBatch.from_arrays([own, batch.column(1).slice(row, to - row), raw], ["digest", "block", "elements"])
                yield out.filter(pc.equal(own, pa.array(digest)))  # another text of the same doc_id is another set

    return docs.select("digest", "block", "text").mapInArrow(releasing(run), "digest long, block long, elements binary")


def _sketches(docs: DataFrame, measure: Measure) -> DataFrame:
    """(digest, block, size, bits) of (digest, block, text): bits are the set's parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, bounds in pieces(batch.column(2)):
                at, _, _, h = words(data, bounds)
                at, h = shingles(at, h, to - row, measure.width)
                sizes, digest = _digests(at, h, to - row)
                own = batch.column(0).slice(row, to - row)
                maps = [_bitmap(x, measure.bits(len(x) * 100 // measure.percent * 100 // measure.percent + 2)).tobytes() for x in np.split(h, np.cumsum(sizes)[:-1])]
                out = pa.RecordBatch.from_arrays([own, batch.column(1).slice(row, to - row), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], ["digest", "block", "size", "bits"])
                yield out.filter(pc.equal(own, pa.array(digest)))  # another text of the same doc_id is another set

    return docs.select("digest", "block", "text").mapInArrow(releasing(run), "digest long, block long, size long, bits binary")


def _bitmap(elements: np.ndarray, bits: int) -> np.ndarray:
    """Every element toggles one of the bits."""
    return np.packbits(np.bincount((elements >> np.uint64(11) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def _joined(maps: np.ndarray, sizes: np.ndarray, measure: Measure, decide) -> list[tuple[int, int]]:
    """Pairs that connect the rows, which go by size, as all those within the bitmaps' bound would that `decide` accepts."""
    root = np.arange(len(sizes))
    out = []
    for i in range(len(sizes) - 1):
        to = int(np.searchsorted(sizes, sizes[i] * 100 // measure.percent, "right"))
        for low in range(i + 1, to, 4096):
            rest = np.arange(low, min(to, low + 4096))
            rest = rest[root[rest] != root[i]]
            if not len(rest):
                continue
            differ = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1)
            for j in rest[differ <= measure.apart(sizes[rest] + sizes[i])].tolist():
                if root[j] != root[i] and decide(i, j):
                    root[root == root[j]] = root[i]
                    out.append((i, j))
    return out


def links_in(sets: list[np.ndarray], measure: Measure) -> list[tuple[int, int]]:
    """Links that connect the sets (sorted arrays) as all links would: at most one fewer than there are sets."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    bits = measure.bits(int(sizes[-1]))
    maps = np.stack([_bitmap(sets[i], bits) for i in order])

    def decide(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
        return measure.linked(both, int(sizes[i]), int(sizes[j]))

    return [(order[i], order[j]) for i, j in _joined(maps, sizes, measure, decide)]


def near_maps(maps: list[bytes], sizes: np.ndarray, measure: Measure) -> list[tuple[int, int]]:
    """Pairs that connect the sets of these bitmaps as all pairs that may link would; longer bitmaps are folded to the shortest."""
    order = np.argsort(sizes, kind="stable")
    words = min(len(x) for x in maps) // 8
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(maps[i], np.uint64).reshape(-1, words), axis=0) for i in order])
    return [(int(order[i]), int(order[j])) for i, j in _joined(folded, sizes[order], measure, lambda i, j: True)]


def near_duplicates(docs: DataFrame, similarity: str | float = "0.8", width: int = 5, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: component_id is the smallest doc_id reachable by links.

    Documents link whose sets of `width`-word shingles have a Jaccard
    similarity of at least `similarity`, a number of hundredths.
    """
    percent = Fraction(str(similarity)) * 100
    if percent.denominator != 1:
        raise ValueError("the similarity has at most two decimals")
    measure = Measure(int(percent), width)
    spark = docs.sparkSession
    signed = saved(signatures(docs, measure, text, id_))
    some = signed.where("digest is not null")
    named = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text"))
    probes = some.select("digest", "n_shingles", F.explode("probes").alias("probe"))
    other = probes.groupBy("probe").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z").select("probe")
    ones = some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"))
    least = F.floor(F.ceil(F.col("size") * measure.percent / 100) / EXTRA) + 1
    hits = probes.join(other, "probe").select("digest", "probe").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("hits"))
    going = saved(ones.join(hits, "digest").where(F.col("hits") >= least).select("digest", F.col("doc_id").alias("id")))
    going_texts = named.join(small(going, going.count()), F.col("doc_id").eqNullSafe(F.col("id")))
    keys = saved(_part_keys(going_texts, measure))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    band = F.col("key").bitwiseAND((1 << _BAND_BITS) - 1).cast("int").alias("band")
    own = Window.partitionBy("digest", "band")
    met = keys.join(met, "key").select("key", "digest", band, "need")
    # what a set that left had in common is counted no more
    met = saved(met.withColumn("met", F.count(F.lit(1)).over(own)).where("met >= need").drop("met"))
    again = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = _agreeing(saved(met.join(again, "key")))
    blocks = components(pairs).select(F.col("node").alias("digest"), F.col("component").alias("block"))

    # the texts of the sets in blocks: one document of each
    wanted = _refined(saved(blocks.join(ones, "digest")), named, measure)
    # a set may hang on keys that no other set keeps
    several = saved(wanted.groupBy("block").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("block"))
    wanted = saved(wanted.join(small(several, several.count()), "block").select("digest", "block", "doc_id", "size"))
    count = wanted.count()
    found = named.join(small(wanted.withColumnRenamed("doc_id", "id"), count), F.col("doc_id").eqNullSafe(F.col("id")))
    got = _sets(found, measure)
    tiles = _tiles(got, wanted.select("block", "size"), measure)
    links = saved(tiles)
    joined = components(links).select(F.col("node").alias("digest"), F.col("component").alias("group"))
    classes = ones.select("digest", F.col("doc_id").alias("least")).join(joined, "digest", "left").withColumn("group", F.coalesce("group", "digest"))
    least = classes.groupBy("group").agg(F.min("least").alias("component_id"))
    named = saved(classes.join(least, "group").select("digest", "component_id"))
    return signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _agreeing(met: DataFrame) -> DataFrame:
    """(a, b): links whose components hold every pair that may be similar, of (key, digest, band, need, n); a may be a key.

    n is the number of sets of a key. Repeated rows only add links.
    """
    own = Window.partitionBy("digest", "band")
    usual = F.col("n") > COMMON
    heavy = lambda need: F.ceil(need * HEAVY.numerator / HEAVY.denominator).cast("int")
    first = own.orderBy(F.col("n") <= COMMON, "n", "key")
    met = met.withColumn("all", F.count(F.lit(1)).over(own)).withColumn("common", F.count(F.when(usual, 1)).over(own))
    met = met.withColumn("place", F.row_number().over(first)).withColumn("least", F.first("key").over(first))
    hangs = usual & (F.col("place") <= F.col("common") - heavy(F.col("need")) + 1)
    counts = ~usual & (F.col("all") - F.col("common") >= F.col("need") - F.least(heavy(F.col("need")) - 1, "common"))
    met = saved(met.where("all >= need").where(hangs | counts).select("key", "digest", "band", "need", F.col("common").cast("int").alias("common"), "least", usual.alias("hangs")))
    # keys are nodes, too: a set hangs on its first key, which hangs on the set's others; near copies share the first one
    hung = met.where("hangs").select(F.col("least").alias("a"), F.col("key").alias("b"), "digest")
    hung = hung.select("a", "b").where("a <> b").union(hung.select("a", "digest"))
    rare = met.where("not hangs").select("key", "digest", "band", "need", "common")
    other = rare.select("key", F.col("digest").alias("b"), F.col("need").alias("need_b"), F.col("common").alias("common_b"))
    need = F.greatest("need", "need_b")
    least = F.greatest(F.lit(1), need - F.least(heavy(need) - 1, "common", "common_b"))
    both = rare.join(other, "key").where("digest < b").select(F.col("digest").alias("a"), "b", "band", least.alias("least"))
    agreed = both.groupBy("a", "b", "band").agg(F.count(F.lit(1)).alias("shared"), F.max("least").alias("least")).where("shared >= least")
    return agreed.select("a", "b").union(hung).distinct()


def _refined(wanted: DataFrame, named: DataFrame, measure: Measure) -> DataFrame:
    """(digest, block, doc_id, size) with the blocks of more than a tile split by bitmaps, which tell more than keys and are far shorter than sets."""
    share = F.sum(F.greatest(F.lit(1 / TILE), F.col("size") / ELEMENTS))
    large = saved(wanted.groupBy("block").agg(share.alias("all")).where("all > 1").select("block"))
    if not (count := large.count()):
        return wanted
    taken = [0]
    of = saved(wanted.join(small(large, count), "block", "left_semi"))
    texts = named.join(small(of.select("digest", "block", F.col("doc_id").alias("id")), of.count()), F.col("doc_id").eqNullSafe(F.col("id")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("digest")
        ids = frame["digest"].tolist()
        links = near_maps(frame["bits"].tolist(), frame["size"].to_numpy(), measure) if len(ids) > 1 else []
        taken[0] += sum(map(len, frame["bits"]))
        del frame
        give_back(taken)
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    dealt = _dealt(saved(_sketches(texts, measure)), of.select("block", "size"), measure, SKETCHES, SKETCH_BYTES, 0)
    near = components(dealt.groupBy("block", "low", "i", "j").applyInPandas(run, "a long, b long").distinct())
    near = near.select(F.col("node").alias("digest"), F.col("component").alias("block"))
    rest = wanted.join(small(large, count), "block", "left_anti").select("digest", "block", "doc_id", "size")
    return saved(rest.unionByName(of.drop("block").join(near, "digest").select("digest", "block", "doc_id", "size")))


def _dealt(got: DataFrame, sized: DataFrame, measure: Measure, tile: int, total: int, whole: int = 1) -> DataFrame:
    """`got`, sets with block and size, by the tiles (block, low, i, j) in which they meet; `sized` has the block and size of every set.

    A block of more than `whole` times `tile` sets, or `total` shingles, is one tile for every
    two neighbouring bands of sizes, of which a pair that may link has at most one
    step between it; two bands of more than that together are dealt by hash into
    chunks that meet in pairs.
    """
    band = lambda size: (F.floor(F.log(F.greatest(size, F.lit(1))) / math.log(100 / measure.percent * 1.0000001)) if measure.percent < 100 else size).cast("long")
    # how many chunks a set takes of a tile
    share = F.sum(F.greatest(F.lit(1 / tile), F.col("size") / total))
    blocks = sized.groupBy("block").agg(share.alias("all"))
    bands = sized.groupBy("block", band(F.col("size")).alias("low")).agg(share.alias("n"))
    above = bands.select("block", (F.col("low") - 1).alias("low"), F.col("n").alias("more"))
    # pairs of bands whose lower one is empty add nothing
    families = bands.join(above, ["block", "low"], "left").join(blocks, "block").where(F.col("all") > whole)
    families = saved(families.select("block", "low", F.ceil(F.col("n") + F.coalesce("more", F.lit(0.0)) - 1e-9).cast("int").alias("chunks")))
    count = families.count()
    large = families.select("block").distinct()
    zero = F.lit(0)
    columns = [c for c in got.columns if c != "block"]
    one = got.join(small(large, count), "block", "left_anti").select("block", F.lit(-1).cast("long").alias("low"), zero.alias("i"), zero.alias("j"), *columns)
    own = band(F.col("size"))
    many = got.join(small(large, count), "block", "left_semi").withColumn("low", F.explode(F.array(own, own - 1))).join(small(families, count), ["block", "low"])
    many = many.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    meet = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda c: F.struct(F.least("own", c).alias("i"), F.greatest("own", c).alias("j")))
    many = many.withColumn("tile", F.explode(meet)).select("block", "low", "tile.i", "tile.j", *columns)
    return one.unionByName(many)


def give_back(taken: list[int]) -> None:
    """Gives memory back after every few MB that tiles, mostly small ones, have taken in a task."""
    if taken[0] >= BATCH_BYTES // 4:
        taken[0] = 0
        release()


def _tiles(got: DataFrame, sized: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): links between digests of (digest, block, elements), found tile by tile; `sized` has the block and size of every set."""
    taken = [0]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("digest")
        sets = [np.frombuffer(x, np.uint64) for x in frame["elements"]]
        ids = frame["digest"].tolist()
        links = links_in(sets, measure) if len(sets) > 1 else []
        taken[0] += sum(map(len, sets)) * 8
        del sets, frame
        give_back(taken)
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    dealt = _dealt(got.withColumn("size", (F.octet_length("elements") / 8).cast("long")), sized, measure, TILE, ELEMENTS).drop("size")
    return dealt.groupBy("block", "low", "i", "j").applyInPandas(run, "a long, b long")
