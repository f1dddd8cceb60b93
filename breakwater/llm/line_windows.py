"""Line dedup by overlapping three-line windows, in DataFrame operations only.

A text's lines are what "\\n" separates. Every three consecutive lines, of which
one at least is not blank, make a window. The first occurrence of a window in
the order (doc_id, line) is kept; every later one covers its three lines, and
the covered lines go. Lines that no later occurrence covers stay.

Null and empty texts, and texts of fewer than three lines, have no windows and
stay as they are. Rows with a null doc_id come first in the order; rows that
share a doc_id are told apart by their text's hash, and exact repeats of a row
are all kept or cut alike. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.llm.shared import join_hot, saved, small


def _keyed(docs: DataFrame, text: str, id_: str) -> DataFrame:
    return docs.withColumn("__key", F.struct(F.col(id_).alias("id"), F.xxhash64(text).alias("part")))


def windows(docs: DataFrame, text: str = "text", id_: str = "doc_id", lines: int = 3) -> DataFrame:
    """(__key, __at, __hash): each window of `lines` lines by its first line's position, counted from 0."""
    split = F.split(F.col(text), "\n")
    hashed = _keyed(docs.select(id_, text), text, id_).select("__key", F.transform(split, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(F.trim(x)).alias("n"))).alias("x")).where(F.size("x") >= lines)
    return (
        hashed.select("__key", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("x") - (lines - 1)), lambda i: F.slice("x", i, lines))).alias("__at", "w"))
        .where(F.exists("w", lambda x: x["n"] > 0))
        .select("__key", "__at", F.xxhash64(*(F.col("w")[k]["h"] for k in range(lines))).alias("__hash"))
    )


def covered(docs: DataFrame, text: str = "text", id_: str = "doc_id", lines: int = 3) -> DataFrame:
    """(__key, __from): for each document that loses lines, the sorted starts of its later occurrences' windows."""
    every = windows(docs, text, id_, lines)
    # a window's first place; only windows that occur twice matter
    first = saved(every.groupBy("__hash").agg(F.min(F.struct("__key", "__at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = join_hot(every, first, ["__hash"]).where((F.col("first.__key") != F.col("__key")) | (F.col("first.__at") != F.col("__at")))
    return later.groupBy("__key").agg(F.sort_array(F.collect_set("__at")).alias("__from"))


def dedup_lines(docs: DataFrame, text: str = "text", id_: str = "doc_id", lines: int = 3) -> DataFrame:
    """`docs` with the covered lines cut from the text, and n_lines and n_removed in new last columns."""
    if taken := {"n_lines", "n_removed", "__key", "__at", "__hash", "__gone"} & set(docs.columns):
        raise ValueError(f"columns exist already: {', '.join(sorted(taken))}")
    marks = saved(covered(docs, text, id_, lines))
    places = marks.agg(F.coalesce(F.sum(F.size("__from")), F.lit(0))).first()[0]
    split = F.split(F.col(text), "\n")
    gone = F.array_distinct(F.flatten(F.transform("__from", lambda p: F.sequence(p, p + (lines - 1)))))
    joined = _keyed(docs, text, id_).join(small(marks, places).withColumn("__gone", gone).drop("__from"), "__key", "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone")), lambda i: split[i])
    return joined.select(
        *(F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(c) for c in docs.columns),
        F.coalesce(F.size(split), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"),
    )
