"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

Vectors are scaled to length 1 and turned by a fixed random rotation. A
vector's code is the signs of its turned components; stored with it is the
inner product f of the vector and its code's unit vector. For a turned query q
the estimate <code, q> / f of the inner product is unbiased, and
`CONFIDENCE` * sqrt((1 - f*f) / f*f / (d - 1)) bounds its error but for a
vanishing share. A query's turned components are rounded to 15 steps; the bound
grows by that error's share. Pairs whose estimate and bound stay below the threshold
are dropped; all others are computed exactly, in double precision.

Candidates meet in buckets: each of several tables takes some signs of further
random directions as a key. Their number follows from the count of vectors, so
that buckets stay small, and the number of tables from the wanted recall at
the threshold (`RECALL`, in expectation; it is higher above it). Equal vectors
are one with a weight. A bucket of more than `TILE` vectors is dealt into
pairs of chunks. Only sketches (code, factor, rounded components, keys) travel to the
buckets; there the estimates tell which vectors have a partner left, and only
those vectors follow in full, to the buckets in which they have one. A pair counts in
the first table only in which it meets, so links are counted, not listed: a tile
returns a count for each vector and no more links than connect its vectors.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are their own component. Vectors of different lengths do not
link. Rows with a null id take part. Repeated rows link. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.shared import components, join_hot, saved, small

TILE = 1500
CONFIDENCE = 4.0
RECALL = 0.998
#: Unrelated vectors of a bucket, about, as a power of 2; tables at most, beyond which buckets grow instead.
BUCKET, TABLES = 9, 400
_ROWS, _STEPS = 2048, 7


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([d, 17]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def plan(count: int, cosine: float) -> tuple[int, int]:
    """(signs of a key, tables): buckets of about 2**`BUCKET` unrelated vectors, the recall reached at the threshold."""
    for bits in range(min(40, max(4, round(math.log2(max(count, 2))) - BUCKET)), 0, -1):
        met = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
        tables = 1 if met >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - met))
        if tables <= TABLES:
            return bits, tables
    return 1, tables


def units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that hold a usable vector, and those as unit vectors in double precision (by row, any length)."""
    rows, out = [], []
    for i, v in enumerate(column):
        x = v.values
        if x is None or not len(x) or x.null_count:
            continue
        x = x.to_numpy(zero_copy_only=False).astype(float)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            continue
        x = x / top
        rows.append(i)
        out.append(x / math.sqrt(x @ x))
    return np.array(rows, int), out


def _coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, weight, d, unit, sketch, keys) of (node, weight, vector): a sketch as `Side` reads it, a bucket key for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(low, _ROWS)
                rows, found = units(batch.column(2))
                for d in sorted({len(x) for x in found}):
                    of = [k for k, x in enumerate(found) if len(x) == d]
                    x = np.array([found[k] for k in of])
                    if d not in turns:
                        turns[d] = rotation(d), np.random.default_rng([d, 23]).standard_normal((d, bits * tables))
                    turn, across = turns[d]
                    turned = x @ turn
                    factor = np.abs(turned).sum(axis=1) / math.sqrt(d)
                    sides = x @ across >= 0
                    keys = (sides.reshape(len(x), tables, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)
                    step = np.maximum(np.abs(turned).max(axis=1) / _STEPS, 1e-30)
                    rounded = np.rint(turned / step[:, None]).astype(np.int8) + 8
                    if d % 2:
                        rounded = np.column_stack((rounded, np.full(len(x), 8, np.int8)))
                    facts = np.column_stack((factor, step)).astype("<f4").view(np.uint8)
                    halves = (rounded[:, ::2] | rounded[:, 1::2] << 4).astype(np.uint8)
                    sketch = np.concatenate((facts, np.packbits(turned >= 0, axis=1), halves, np.packbits(sides, axis=1)), axis=1)
                    take = pa.array(rows[of])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(x), d)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                        ["node", "weight", "d", "unit", "sketch", "keys"],
                    )

    return vectors.mapInArrow(run, "node long, weight long, d long, unit binary, sketch binary, keys array<long>")


class Side:
    """Vectors of tiles as arrays, opened from their sketches; `unit` and `weight` only where they came along."""

    def __init__(self, node, factor, step, code, query, keys, unit=None, weight=None):
        self.node, self.factor, self.step, self.code, self.query, self.keys, self.unit, self.weight = node, factor, step, code, query, keys, unit, weight

    @classmethod
    def of(cls, frame: pd.DataFrame, d: int, bits: int, tables: int) -> Side:
        raw = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
        facts = np.ascontiguousarray(raw[:, :8]).view("<f4").astype(float)
        at = 8 + -(-d // 8)
        code = np.unpackbits(raw[:, 8:at], axis=1, count=d)
        halves = raw[:, at : at + -(-d // 2)]
        rounded = np.stack((halves & 15, halves >> 4), axis=2).reshape(len(frame), -1)[:, :d].astype(np.float32) - 8
        sides = np.unpackbits(raw[:, at + -(-d // 2) :], axis=1, count=bits * tables).reshape(len(frame), tables, bits)
        more = (np.frombuffer(b"".join(frame["unit"]), float).reshape(-1, d), frame["weight"].to_numpy()) if "unit" in frame else ()
        return cls(frame["node"].to_numpy(), facts[:, 0], facts[:, 1], code, rounded * facts[:, 1:].astype(np.float32), (sides.astype(np.int64) << np.arange(bits)).sum(axis=2), *more)

    def at(self, rows: np.ndarray) -> Side:
        return Side(*(None if x is None else x[rows] for x in (self.node, self.factor, self.step, self.code, self.query, self.keys, self.unit, self.weight)))


def near(a: Side, b: Side, table: int, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in `a` and `b` of pairs that may be linked and meet first in this table; of a chunk with itself each pair once."""
    d = a.code.shape[1]
    spread = np.sqrt(np.maximum(1 - a.factor**2, 0) / a.factor**2 / max(d - 1, 1))
    rounding = b.step.max(initial=0) / math.sqrt(12)
    error = CONFIDENCE * np.sqrt(spread**2 + (rounding / a.factor) ** 2) + 1e-5
    for low in range(0, len(a.node), 256):
        some = slice(low, low + 256)
        signs = (a.code[some].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
        estimate = (signs @ b.query.T) / a.factor[some, None]
        i, j = np.nonzero(estimate + error[some, None] >= cosine)
        if same:
            i, j = i[j > i + low], j[j > i + low]
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)] + low, j[k : k + (1 << 15)]
            first = (a.keys[p, :table] != b.keys[q, :table]).all(axis=1)
            yield p[first], q[first]


def linked(a: Side, b: Side, table: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and `b` of the pairs of `near` that are linked, by exact inner products."""
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for p, q in near(a, b, table, cosine, same):
        good = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= cosine
        left.append(p[good])
        right.append(q[good])
    return np.concatenate(left), np.concatenate(right)


def _tiles(frame: pd.DataFrame, side: Side) -> Iterator[tuple[np.ndarray, Side, Side, bool]]:
    """(rows, a, b, same) of each tile of a frame with columns bucket, i, j, own: its chunk i and its chunk j."""
    own = frame["own"].to_numpy()
    for (_, i, j), rows in frame.groupby(["bucket", "i", "j"], sort=False).indices.items():
        left, right = rows[own[rows] == i], rows[own[rows] == j]
        if len(left) and len(right) and len(rows) > 1:
            a = side.at(left)
            yield (left if i == j else np.concatenate((left, right))), a, (a if i == j else side.at(right)), i == j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches by the links."""
    label = np.arange(n)
    while True:
        was = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == was).all():
            return label


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_).alias("vec_id"), F.col(vector).alias("vector"))
    digest = F.xxhash64("vector")
    kept = saved(named.select("vec_id", digest.alias("node")))
    groups = named.where("size(vector) > 0").select("vector", digest.alias("node")).groupBy("node").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"))
    count = kept.count()
    bits, tables = plan(count, cosine)
    coded = saved(_coded(groups.select("node", "weight", "vector"), bits, tables))
    rows = coded.select("d", F.posexplode("keys").alias("t", "bucket"), "node", "sketch")
    sizes = saved(rows.groupBy("d", "t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int")))
    dealt = join_hot(rows, sizes, ["d", "t", "bucket"])
    own = F.pmod(F.xxhash64("node", "bucket"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    tiles = F.transform(every, lambda c: F.struct(F.least(F.col("own"), c).alias("i"), F.greatest(F.col("own"), c).alias("j")))
    dealt = dealt.withColumn("own", own).withColumn("tile", F.explode(tiles)).drop("chunks")
    # a call of the kernel takes several buckets of a table
    lots = F.pmod(F.xxhash64("bucket", "tile.i", "tile.j"), F.lit(max(1, count // 16_000))).cast("int").alias("lot")
    dealt = dealt.select("d", "t", lots, "bucket", "tile.i", "tile.j", "own", "node", "sketch")

    def partnered(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """The rows of a tile that have a partner in it by estimate."""
        d, t = key[0], key[1]
        out = []
        for at, a, b, same in _tiles(frame, Side.of(frame, d, bits, tables)):
            some = np.zeros(len(at), bool)
            for p, q in near(a, b, t, cosine, same):
                some[p] = True
                some[q if same else q + len(a.node)] = True
            out.append(at[some])
        return frame.iloc[np.concatenate(out) if out else []][["d", "t", "lot", "bucket", "i", "j", "own", "node"]]

    left = saved(dealt.groupBy("d", "t", "lot").applyInPandas(partnered, "d long, t int, lot int, bucket long, i int, j int, own int, node long"))
    nodes = left.select("node").distinct()
    asked = coded.join(small(nodes, left.count()), "node", "left_semi").select("node", "weight", "unit", "sketch")
    exact = left.join(asked, "node")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        d, t = key[0], key[1]
        out = [np.zeros((3, 0), np.int64)]
        for _, a, b, same in _tiles(frame, Side.of(frame, d, bits, tables)):
            p, q = linked(a, b, t, cosine, same)
            if not len(p):
                continue
            node, weight = (a.node, a.weight) if same else (np.concatenate((a.node, b.node)), np.concatenate((a.weight, b.weight)))
            q = q if same else q + len(a.node)
            n = np.bincount(p, weight[q], len(node)) + np.bincount(q, weight[p], len(node))
            some = np.flatnonzero(n)
            out.append(np.stack((node[some], n[some].astype(np.int64), node[forest(len(node), p, q)[some]])))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["node", "links", "root"])

    found = saved(exact.groupBy("d", "t", "lot").applyInPandas(run, "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    copies = kept.join(coded.select("node", "weight"), "node")
    grouped = coded.select("node", "weight").join(counts, "node", "left").join(joined, "node", "left").select("node", "weight", "links", F.coalesce("component", "node").alias("group"))
    least = copies.join(grouped.select("node", "group"), "node").groupBy("group").agg(F.min("vec_id").alias("least"))
    verdict = saved(grouped.join(least, "group").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "least"))
    out = kept.join(verdict, "node", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
