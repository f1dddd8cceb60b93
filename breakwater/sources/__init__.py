"""Readers of series and sinks of results: thin forms of Spark's own, with explicit schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breakwater.api import Detection

#: Schemas of well-known example data sets; the data are the user's.
SCHEMAS = {
    "well_log": "row_index long, x double",
    "bitcoin": "date timestamp, price double",
    # fixed values: the numbers of the individuals, and the columns of the monthly series
    "transcriptome": ", ".join(f"`{i}` double" for i in (3, 4, 5, 6, 7, 8, 9, 10, 14, 15, 16, 17, 18, 19, 21, 22, 24, 26, 28, 30, 31, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 53, 54, 57)),
    "uk_seatbelts": ", ".join(f"{c} double" for c in ("DriversKilled", "drivers", "front", "rear", "kms", "PetrolPrice", "VanKilled", "law")),
    "occupancy": "date string, Temperature double, Humidity double, Light double, CO2 double, HumidityRatio double, Occupancy int",
}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("header", header)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, epoch_ms: str | None = None) -> DataFrame:
    """JSON lines; a column of milliseconds since 1970 becomes a UTC timestamp."""
    df = spark.read.schema(schema).json(path)
    return df.withColumn(epoch_ms, F.timestamp_millis(F.col(epoch_ms))) if epoch_ms else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_array(spark: SparkSession, z) -> DataFrame:
    """A numpy array as row_index and x1, x2, ..., for interactive use."""
    import numpy as np

    z = np.asarray(z, float)
    z = z[:, None] if z.ndim == 1 else z
    names = ["row_index", *(f"x{j + 1}" for j in range(z.shape[1]))]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(z)], ", ".join([f"{n} {'long' if n == 'row_index' else 'double'}" for n in names]))


def _terms(text: str) -> list[str]:
    """The terms between plus signs outside brackets; `a*b` stands for a, b and a:b."""
    out, depth, term = [], 0, ""
    for ch in text + "+":
        depth += (ch == "(") - (ch == ")")
        if ch == "+" and not depth:
            out.append(term)
            term = ""
        else:
            term += ch
    every = []
    for term in filter(None, out):
        parts = term.split("*") if "(" not in term else [term]
        every += parts
        every += [f"{a}:{b}" for i, a in enumerate(parts) for b in parts[i + 1 :]]
    return list(dict.fromkeys(every))


def formula(df: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """`y ~ a + b`, `y ~ .` with or without `- 1`: (df, values), an intercept column unless `- 1` is there.

    A term may be a column, `a:b` (a product), `a*b` (both and their product), or an
    expression in brackets such as `log(a)` or `I(a^2)`, `^` being a power. Strings
    become indicator columns of their values but the least, which are few:
    they are collected once for each string column.
    """
    left, _, right = text.partition("~")
    responses = [x.strip() for x in left.replace("cbind(", "").replace(")", "").split(",") if x.strip()]
    right = right.replace(" ", "")
    intercept = not right.endswith(("-1", "+0"))
    terms = _terms(right if intercept else right[:-2])
    kinds = dict(df.dtypes)
    names = [c for c in df.columns if c not in responses] if terms == ["."] else terms
    out = []
    if intercept:
        df = df.withColumn("intercept", F.lit(1.0))
        out.append("intercept")

    def columns(c: str) -> list[str]:
        """The columns of a term, added to `df` where they are new."""
        nonlocal df
        if kinds.get(c) == "string":
            levels = [r[0] for r in df.select(c).distinct().orderBy(c).limit(1001).collect() if r[0] is not None]
            if len(levels) > 1000:
                raise ValueError(f"column {c!r} has over 1000 values")
            for v in levels[1:] if intercept else levels:
                df = df.withColumn(f"{c}_{v}", (F.col(c) == v).cast("double"))
            return [f"{c}_{v}" for v in (levels[1:] if intercept else levels)]
        if c in kinds:
            return [c]
        if ":" in c and "(" not in c:
            a, b = (columns(x) for x in c.split(":", 1))
            for x in a:
                for y in b:
                    df = df.withColumn(f"{x}:{y}", F.col(f"`{x}`") * F.col(f"`{y}`"))
            return [f"{x}:{y}" for x in a for y in b]
        if "(" not in c:
            raise ValueError(f"there is no column {c!r}")
        inner = c[2:-1] if c.startswith("I(") else c
        df = df.withColumn(c, F.expr(re.sub(r"(\w+|\([^()]*\))\^(\w+)", r"power(\1, \2)", inner)).cast("double"))
        return [c]

    for c in names:
        out += [x for x in columns(c) if x not in out]
    return df, [*responses, *out]


def write(result: Detection, path: str) -> None:
    """Change points, segments and residuals as three Parquet tables below `path`."""
    for name in ("change_points", "segments", "residuals"):
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")
