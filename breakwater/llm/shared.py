"""What the operators share: the checkpoint folder, components of a graph, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sides of at most so many bytes, by their counted rows and a row's width, are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


#: Python kernels take batches of about so many bytes, whatever the number of rows.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches have at most `BATCH_BYTES` (or what the session allows, if that is less); the setting is put back."""
    was = spark.conf.get(_BATCH)
    if was.rstrip("b").isdigit() and int(was.rstrip("b")) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, was)


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the folder in spark.checkpoint.dir and read back, so that a lost executor costs no earlier stage.

    A written table, unlike checkpoint(), has its true size for the
    optimiser. The tables stay in the application's folder there until that is
    deleted. Only where that setting is missing (a local test) is a
    temporary folder taken.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    path = f"{context._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, width: int = 48) -> DataFrame:
    """`df` with a broadcast hint if its counted `rows` of `width` bytes each are within `BROADCAST_BYTES`."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


#: A key of more rows than `HOT_ROWS`, and than one in `HOT_KEYS` of all, is hot: there are at most `HOT_KEYS` of them.
HOT_ROWS, HOT_KEYS = 10_000, 1000


def join_hot(rows: DataFrame, facts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """`rows` joined with `facts`, a written table with one row for each key and in `n` its number of rows.

    Facts of hot keys are few whatever the data, so they are broadcast and their
    rows stay where they are; all other rows are joined as usual.
    """
    total, most = facts.agg(F.sum(n), F.max(n)).first()
    bar = max((total or 0) // HOT_KEYS, HOT_ROWS)
    if (most or 0) <= bar:
        return rows.join(facts.drop(n), on)
    hot = facts.where(F.col(n) > bar).drop(n)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.where(F.col(n) <= bar).drop(n), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges that are joined up in the driver, once no more are left.
FEW = 10_000


def _roots(edges: list[tuple]) -> list[tuple]:
    """(node, root) of every node of a few edges."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    return [(x, find(x)) for x in list(root)]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component being the smallest node.

    A round hooks every node to the least of itself and its neighbours, in an order by hash
    that is another in each round, jumps once further and puts these nodes in the
    edges' place; loops and repeated edges go, so that rounds, of which there are few, read
    ever fewer edges. The last `FEW` come to the driver. A node's roots are then followed
    from the last round's few nodes back to the first's. Joins make as many rows as
    edges or nodes are left.
    Nodes are the endpoints; loops are allowed; null endpoints are dropped.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    ordered = lambda u, v: (F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    left, rounds = saved(links.select(*ordered("u", "v")).distinct()), []
    while left.count() > FEW:
        ranked = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("rank"), F.col(c).alias("node"))
        best = left.union(left.select("v", "u")).groupBy("u").agg(F.min(ranked("v")).alias("best"))
        hooked = saved(best.select(F.col("u").alias("node"), F.least("best", ranked("u"))["node"].alias("next")))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("root"))
        roots = saved(hooked.join(jump, "next").select("node", "root"))
        of = {end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in "uv"}
        moved = left.where("u <> v").join(of["u"], "u").join(of["v"], "v").where("u_root <> v_root")
        left = saved(moved.select(*ordered("u_root", "v_root")).distinct())
        rounds.append(roots)
    few = _roots([tuple(x) for x in left.collect()])
    kind = left.schema["u"].dataType
    last = small(left.sparkSession.createDataFrame(few, T.StructType([T.StructField("node", kind), T.StructField("root", kind)])), len(few))
    for roots in reversed(rounds):
        further = last.select(F.col("node").alias("root"), F.col("root").alias("further"))
        last = roots.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    last = saved(last)
    return saved(last.join(last.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component"))


def crc_remainder(id_: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % n
