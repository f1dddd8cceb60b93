"""Chunk-and-merge plan for one very long series: candidates from overlapping chunks, then an exact programme over them.

Approximate: a change that no chunk proposes is not found. Rows are dealt by
the range of their order column and numbered from partition counts, so no
task ever sees the whole series; the last step sees the candidates' running
sums only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from breakwater import spec as specs
from breakwater.kernels.segment import adjusted, segment
from breakwater.series import Series

FAMILIES = ("mean", "meanvariance", "exponential")


def numbered(s: Series, partitions: int) -> DataFrame:
    """The rows with `row_index` from 0 by the order column: counts per range partition, not a global window."""
    # kept until the rows' statistics and the proposals are made; Spark drops the blocks with the last plan that holds them
    dealt = s.df.repartitionByRange(partitions, s.order_by).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    counts = dealt.groupBy("__part").count()
    before = counts.select("__part", (F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(s.order_by)) - 1
    # as many rows as range partitions
    return dealt.join(F.broadcast(before), "__part").select(s.order_by, *s.values, (inside + F.coalesce("__before", F.lit(0))).cast("long").alias("row_index"))


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def change_points(s: Series, spec: specs.Spec, chunk: int = 50_000, overlap: int = 5_000, partitions: int | None = None) -> DataFrame:
    """(cp_index, order_value) of one series without partition keys."""
    if spec.family not in FAMILIES or len(s.values) != 1 or s.partition_by:
        raise ValueError(f"one series of one value and a family of {', '.join(FAMILIES)} are needed")
    value, order = s.values[0], s.order_by
    rows = numbered(s, partitions or int(s.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).first()
    n = int(facts["n"])
    if n < 2:
        return rows.select(F.lit(0).cast("long").alias("cp_index"), F.col(order).alias("order_value")).limit(0)
    variance = spec.variance
    if spec.family == "mean" and variance is None:
        # chunks' own differences; those between chunks are too few to matter
        d = rows.withColumn("c", F.floor(F.col("row_index") / chunk)).withColumn("d", F.col(value) - F.lag(value, 1).over(Window.partitionBy("c").orderBy("row_index")))
        variance = [[float(d.agg(F.avg(F.col("d") * F.col("d")) / 2).first()[0])]]
    p = specs.parameter_count(spec, 1)
    beta = specs.penalty(spec.beta, p, n)
    inner = specs.replace(spec, beta=beta, variance=variance, cp_only=True, trim=0.0)
    first = F.floor(F.col("row_index") / chunk).cast("long")
    last = F.floor((F.col("row_index") + overlap) / chunk).cast("long")
    dealt = rows.withColumn("chunk", F.explode(F.array_distinct(F.array(first, last))))

    def propose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_index")
        found = segment(frame[value].to_numpy(float), inner).change_points
        return pd.DataFrame({"cp_index": frame["row_index"].to_numpy()[found - 1] + 1 if len(found) else np.zeros(0, np.int64)})

    # a chunk a task: chunks are few beside the rows
    proposed = dealt.repartition(max(partitions_of(rows), -(-n // chunk)), "chunk").groupBy("chunk").applyInPandas(propose, "cp_index long").distinct()
    # sums of the stretches between neighbouring proposals
    x = F.col(value) - F.lit(facts["mean"] if spec.family != "exponential" else 0.0)
    marks = rows.join(proposed.withColumn("row_index", F.col("cp_index")).drop("cp_index").withColumn("cut", F.lit(1)), "row_index", "left")
    block = F.floor(F.col("row_index") / chunk)
    per = marks.withColumn("block", block).withColumn("own", F.sum(F.coalesce("cut", F.lit(0))).over(Window.partitionBy("block").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)))
    stretch = per.groupBy("block", "own").agg(F.count(F.lit(1)).alias("m"), F.sum(x).alias("a"), F.sum(x * x).alias("b"), F.max(F.struct("row_index", F.col(order).alias("at"))).alias("end"))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        ends = frame["end"].map(lambda e: e["row_index"]).to_numpy() + 1
        by = np.argsort(ends)
        m, a, b = (np.concatenate(([0.0], np.cumsum(frame[c].to_numpy(float)[by]))) for c in "mab")
        at, ends = [frame["end"].iloc[i]["at"] for i in by], ends[by]
        k = len(by)
        best, back = np.zeros(k + 1), np.zeros(k + 1, int)
        best[0] = -beta
        for t in range(1, k + 1):
            n_, s_, q_ = m[t] - m[:t], a[t] - a[:t], b[t] - b[:t]
            if spec.family == "mean":
                cost = (q_ - s_ * s_ / n_) / 2 / variance[0][0]
            elif spec.family == "meanvariance":
                cost = n_ / 2 * np.log(np.maximum(q_ / n_ - (s_ / n_) ** 2, 1e-10))
            else:
                cost = n_ * (np.log(s_ / n_) + 1)
            value_ = best[:t] + adjusted(cost, n_, spec.adjustment, p) + beta
            back[t] = int(value_.argmin())
            best[t] = value_[back[t]]
        points, t = [], back[k]
        while t > 0:
            points.append(t)
            t = back[t]
        kept = [i for i in points[::-1] if spec.trim * n < ends[i - 1] < (1 - spec.trim) * n]
        return pd.DataFrame({"cp_index": [int(ends[i - 1]) for i in kept], "order_value": [at[i - 1] for i in kept]})

    kind = dict(s.df.dtypes)[order]
    # as many rows as proposals and chunks
    return stretch.groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: merge(f), f"cp_index long, order_value {kind}")
