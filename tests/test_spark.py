"""The library on Spark: grouped runs, frames, plans, SQL form, streams, sources; queries against DuckDB."""

import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from breakwater import api, catalog, sources, spec, sql
from breakwater.kernels.segment import segment
from breakwater.streaming import Online, detect_stream

SF = "/root/testdata/sf0.001"
#: Queries whose SQL is quick on the smallest tables.
ORACLES = sorted(catalog.oracle_sql())


def series(n=200, seed=1, keys=3):
    r = np.random.default_rng(seed)
    out = []
    for k in range(keys):
        cut = n // 5 + n // 7 * k
        z = np.concatenate((r.normal(0, 1, cut), r.normal(6, 1, n - cut)))
        out += [(f"k{k}", i * 10, float(v)) for i, v in enumerate(z)]
    r.shuffle(out)
    return pd.DataFrame(out, columns=["k", "t", "x"]).astype({"t": int, "x": float})


def test_grouped_is_as_single_runs(spark):
    pdf = series()
    df = spark.createDataFrame(pdf)
    got = api.mean(df.repartition(7), "x", "t", "k")
    for k, part in pdf.groupby("k"):
        want = segment(part.sort_values("t")["x"].to_numpy(), spec.make("mean"))
        rows = got.change_points.where(F.col("k") == k).orderBy("cp_index").collect()
        assert [r["cp_index"] for r in rows] == want.change_points.tolist()
        assert [r["order_value"] for r in rows] == [(c - 1) * 10 for c in want.change_points.tolist()]
    assert got.residuals.count() == len(pdf)
    assert got.segments.groupBy("k").agg(F.max("end_index").alias("n")).where("n = 200").count() == 3
    assert got.thetas.count() == got.segments.count()
    frame = got.plot_frame()
    assert frame.count() == len(pdf) and frame.where("is_change").count() == got.change_points.count()
    assert "family mean" in got.summary() and "Change points: 40" in got.summary()


def test_errors(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": [1, 1, 2], "x": [1.0, 2.0, 3.0], "s": ["a", "b", "c"]}))
    with pytest.raises(Exception, match="repeats"):
        api.mean(df, "x", "t", keep=False).segments.collect()
    for call in (lambda: api.mean(df, "s", "t"), lambda: api.mean(df, "nope", "t"), lambda: api.mean(df, [], "t"), lambda: api.detect(df, "x", "t", family="none"), lambda: api.mean(df, "x", "t", null_policy="?")):
        with pytest.raises(ValueError):
            call()
    nulls = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "t int, x double")
    with pytest.raises(Exception, match="null"):
        api.mean(nulls, "x", "t", keep=False).segments.collect()
    assert api.mean(nulls, "x", "t", null_policy="drop", keep=False).segments.collect()[0]["end_index"] == 2


def test_array_values_and_empty(spark):
    r = np.random.default_rng(0)
    z = np.concatenate((r.normal(0, 1, (60, 4)), r.normal(4, 1, (60, 4))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "t int, v array<double>")
    assert [x["cp_index"] for x in api.mean(df, "v", "t", keep=False).change_points.collect()] == [60]
    assert api.mean(df.limit(0), "v", "t", keep=False).segments.count() == 0


def test_long_series_by_chunks(spark):
    r = np.random.default_rng(5)
    z = np.concatenate((r.normal(0, 1, 3000), r.normal(3, 1, 2500), r.normal(-1, 1, 4500)))
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(len(z)), "x": z}))
    for family in ("mean", "meanvariance"):
        got = sorted(x["cp_index"] for x in api.detect_long(df, "x", "t", family, chunk=1500, overlap=200).collect())
        assert got == segment(z, spec.make(family)).change_points.tolist()


def test_table_function(spark):
    sql.register(spark)
    pdf = series()
    spark.createDataFrame(pdf.assign(w=0.5)).createOrReplaceTempView("q")
    want = {(k, c) for k, part in pdf.groupby("k") for c in (*segment(part.sort_values("t")["x"].to_numpy(), spec.make("mean")).change_points.tolist(), 200)}
    options = '{"order_by": "t", "values": ["x"], "partition_by": ["k"]}'
    for text in (f"changepoints(TABLE(q) PARTITION BY k ORDER BY (t), 'mean', '{options}')", f"changepoints_by(TABLE(q), 'mean', '{options}')"):
        rows = spark.sql(f"SELECT * FROM {text}").collect()
        assert {(r["k"], r["end_index"]) for r in rows} == want and len(rows) == len(want)
        assert all(r["last_order"] == (r["end_index"] - 1) * 10 for r in rows)
    one = spark.sql("SELECT * FROM changepoints(TABLE(SELECT t, x FROM q WHERE k = 'k0') WITH SINGLE PARTITION ORDER BY (t), 'mean', '{\"order_by\": \"t\"}') ORDER BY 1")
    assert [r["end_index"] for r in one.collect()] == [40, 200]
    with pytest.raises(Exception, match="order_by"):
        spark.sql("SELECT * FROM changepoints(TABLE(q) PARTITION BY k ORDER BY (t), 'mean')").collect()


def test_online_equals_batch():
    z = series(keys=1).sort_values("t")["x"].to_numpy()
    run = Online("mean", 10.0)
    last = [run.add(x) for x in z]
    want = segment(z, spec.make("mean", variance=[[1.0]], beta=10.0, cost_adjustment="BIC"))
    assert last == want.backpointers[1:].tolist()


def test_stream(spark, tmp_path):
    pdf = series(keys=2, n=60).sort_values("t")
    for i, part in enumerate(np.array_split(pdf, 3)):
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k string, t long, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = detect_stream(stream, "k", "t", "x", "mean", 10.0).writeStream.format("memory").queryName("out").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        got = spark.sql("SELECT * FROM out").toPandas()
    finally:
        q.stop()
    assert len(got) == len(pdf)
    for k, part in pdf.groupby("k"):
        run = Online("mean", 10.0)
        assert got[got["k"] == k].sort_values("t")["last_change"].tolist() == [run.add(x) for x in part.sort_values("t")["x"]]


def test_sources(spark, tmp_path):
    df = sources.from_array(spark, np.arange(6.0).reshape(3, 2))
    assert df.columns == ["row_index", "x1", "x2"]
    (tmp_path / "a.csv").write_text("y,g,z\n1,a,2\n3,b,4\n")
    csv = sources.read_csv(spark, str(tmp_path / "a.csv"))
    wide, values = sources.formula(csv, "y ~ .")
    assert values == ["y", "intercept", "g_b", "z"] and wide.count() == 2
    assert sources.formula(csv, "y ~ z - 1")[1] == ["y", "z"]
    more, values = sources.formula(csv, "y ~ z*g + I(z^2) + log(z + 1) - 1")
    assert values == ["y", "z", "g_a", "g_b", "z:g_a", "z:g_b", "I(z^2)", "log(z+1)"]
    row = more.orderBy("y").collect()[1]
    assert (row["z:g_b"], row["z:g_a"], row["I(z^2)"]) == (4.0, 0.0, 16.0) and row["log(z+1)"] == pytest.approx(np.log(5))
    assert len(api.lm(more.withColumn("t", F.col("y")), ["y", "I(z^2)"], "t", keep=False).series.values) == 2
    with pytest.raises(ValueError, match="no column"):
        sources.formula(csv, "y ~ nothing")
    assert [len(spark.createDataFrame([], v).columns) for k, v in sorted(sources.SCHEMAS.items())] == [2, 7, 43, 8, 2]
    (tmp_path / "a.json").write_text('{"date": 0, "price": 1.5}\n')
    assert str(sources.read_json(spark, str(tmp_path / "a.json"), "date long, price double", "date").dtypes[0][1]).startswith("timestamp")
    result = api.mean(spark.createDataFrame(series()), "x", "t", "k")
    sources.write(result, f"{tmp_path}/r")
    assert sources.read_parquet(spark, f"{tmp_path}/r/segments").count() == result.segments.count()


def test_columns_are_pruned(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    plan = api.mean(df, "value", "event_id", "event_type", keep=False).nested._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "user_id" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_other_packages():
    """Without a package that only the other operators need, the library's own queries are there."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__), check=True).stdout.split()
    assert said == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]


@pytest.mark.parametrize("name", ["cp_garch", "cp_ma"])
def test_whole_monthly_series(spark, name):
    """Segments cover every month, without gaps."""
    rows = catalog.queries()[name](spark, SF).orderBy("start_index").collect()
    assert [r["start_index"] for r in rows] == [1, *(r["end_index"] + 1 for r in rows[:-1])]
    assert rows[-1]["end_index"] == catalog.monthly(spark, SF).count()


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], atol=2e-2 if name.startswith("prefix") else 2e-6, equal_nan=True)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist()


def test_table_function_keeps_arrays():
    """Rows that wait for the end of their partition are numbers, not Python objects; other order columns are kept as they are."""
    import datetime
    import tracemalloc

    from pyspark.sql import Row

    options = '{"order_by": "t", "values": ["x"], "partition_by": ["k"]}'
    z = np.concatenate((np.random.default_rng(1).normal(0, 1, 150_000), np.random.default_rng(2).normal(6, 1, 50_000)))
    made = Row("k", "t", "x")
    one = sql._ChangePoints()
    tracemalloc.start()
    for i, x in enumerate(z):
        one.eval(made("a", i * 1_000_000, float(x)), "mean", options)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40 * len(z)
    day = datetime.date(2000, 1, 1)
    for place in (lambda i: i, lambda i: f"{i:05}", lambda i: day + datetime.timedelta(i), lambda i: (i, 0), lambda i: i / 2 if i % 2 else i // 2):
        some = sql._ChangePoints()
        for i in [*range(50, 100), *range(50)]:
            some.eval(made("a", place(i), float(i >= 60) * 9 + i % 3), "mean", options)
        assert list(some.terminate()) == [("a", 0, 1, 60, place(59)), ("a", 1, 61, 100, place(99))]
    assert list(sql._ChangePoints().terminate()) == []
    with pytest.raises(ValueError, match="nulls"):
        some = sql._ChangePoints()
        some.eval(made("a", None, 1.0), "mean", options)
        list(some.terminate())


def test_residuals_leave_in_batches():
    """A series' residuals are arrays from its values to its rows, never one object a row."""
    import tracemalloc

    import pyarrow as pa

    from breakwater.plans import grouped

    n = 200_000
    z = np.random.default_rng(1).normal(0, 1, n)
    t = np.random.default_rng(2).permutation(n)
    batches = [pa.RecordBatch.from_arrays([pa.array(["a"] * 10_000), pa.array(t[i : i + 10_000]), pa.array(z[i : i + 10_000])], ["k", "t", "x"]) for i in range(0, n, 10_000)]
    rows, most, held = 0, 0, []
    tracemalloc.start()
    for out in grouped._residual_rows((pa.scalar("a"),), iter(batches), spec.make("mean", variance=[[1.0]], beta=40.0, cost_adjustment="BIC", pruning=0.0), ["x"], "t", ["k"]):
        assert out.schema.names == ["k", "row_index", "order_value", "residual"] and out.column("order_value").to_pylist() == list(range(rows, rows + out.num_rows))
        held.append(np.asarray(out.column("residual").flatten()))
        rows, most = rows + out.num_rows, max(most, out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and most < n and np.allclose(np.concatenate(held), z[np.argsort(t)] - z.mean())
    assert peak < 130 * n


def test_kinds_of_keys_and_orders(spark):
    """Dates, timestamps, decimals and several keys come through as they are."""
    rows = [(k, i, float(i >= 30) * 9 + i % 3) for k in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, x double").withColumn("d", F.expr("date_add(DATE'2020-01-01', i)")).withColumn("s", F.expr("timestamp_seconds(i * 86400)")).withColumn("c", F.expr("CAST(i AS DECIMAL(10, 2))")).withColumn("j", F.expr("CAST(7.5 AS DECIMAL(4, 1))"))
    for order in ("d", "s", "c"):
        got = api.mean(df, "x", order, ["k", "j"], keep=False)
        want = df.where("i = 29").select("k", "j", F.col(order).alias("order_value")).collect()
        assert sorted(map(str, got.change_points.select("k", "j", "order_value").collect())) == sorted(map(str, want))
        assert got.residuals.count() == 120 and got.residuals.where("order_value IS NULL OR size(residual) <> 1").count() == 0
    single = api.mean(df.where("k = 'a'"), "x", "i", keep=False)
    assert single.residuals.count() == 60 and [r["order_value"] for r in single.change_points.collect()] == [29]
