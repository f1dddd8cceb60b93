"""The pipeline's stages in order, each held against brute force on what its predecessor kept."""

import base64
import hashlib
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
import corpus_pipeline
from test_texts import brute_components, brute_lines

from breakwater.llm import queries, shared, toxicity

SF = "/root/testdata/sf0.001"


def brute_item_in(item: str, text: str) -> bool:
    """Whether the item's words stand in the text, four fifths of them at least, case and outer punctuation aside."""
    strip = lambda t: [w.strip(".,;:!?'\"()[]*$%&#|").lower() for w in t.split()]
    a, b = strip(item), strip(text)
    return len(a) >= 5 and any(sum(x == y for x, y in zip(a, b[i:])) >= 0.8 * len(a) for i in range(len(b) - 4))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs.toPandas(), spark.read.parquet(f"{tmp_path}/{i}")
        kept.append((name, before, docs.toPandas()))
    (_, a, b), (_, c, d), (_, e, f), (_, g, h), (_, j, k) = kept

    labels = queries.table(spark, SF, "labels")
    truth = dict(labels.select("doc_id", "toxic").toPandas().itertuples(index=False))
    scored = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)).toPandas()
    assert set(b["doc_id"]) == set(scored[scored["score"] < toxicity.THRESHOLD]["doc_id"])
    assert sum(truth[x] for x in b["doc_id"] if x in truth) <= 0.5 * max(1, sum(truth.values()))  # a dozen toxic rows in all
    assert b.set_index("doc_id")["text"].to_dict() == {x: t for x, t in zip(a["doc_id"], a["text"]) if x in set(b["doc_id"])}

    lines = {x: (t, n) for x, t, n in brute_lines(list(zip(c["doc_id"], c["text"])))}
    whole = {x: len(t.split("\n")) for x, t in zip(c["doc_id"], c["text"])}
    assert d.set_index("doc_id")["text"].to_dict() == {x: t for x, (t, n) in lines.items() if not n or n < whole[x]}
    assert all(len(t) == n for t, n in zip(d["text"], d["n_chars"]) if t is not None)

    classes = brute_components(list(zip(e["doc_id"], e["text"])), 5, 80)
    assert set(f["doc_id"]) == {x for x, _, component in classes if x == component}

    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]
    leaks = {x for x, t in zip(g["doc_id"], g["text"]) if any(brute_item_in(i, t) for i in items)}
    assert set(h["doc_id"]) == set(g["doc_id"]) - leaks

    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(x): int(r) for x, r in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {x: np.array(encoding.encode_ordinary(t), "<u4") for x, t in zip(j["doc_id"], j["text"])}
    got = k.set_index("doc_id")
    assert set(got.index) == set(ids)
    for x, v in ids.items():
        assert bytes(got.loc[x, "token_ids"]) == v.tobytes()
        assert got.loc[x, "n_tokens"] == len(v) and got.loc[x, "ids_sha256"] == hashlib.sha256(v.tobytes()).hexdigest()


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in entry.queries()


def test_tokens_come_from_small_batches(spark):
    """Texts are encoded within a write of the stage's own, in one kernel: a caller's batches may be far larger."""
    ended = []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = corpus_pipeline.tokenise(spark, docs, SF)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    for k in range(before, runs.size()):
        x = runs.apply(k)
        if kernels := x.physicalPlanDescription().partition("\n\n")[0].count("MapInArrow"):
            batch = x.modifiedConfigs().get(shared._BATCH)
            ended.append((kernels, batch.isDefined() and int(batch.get()) <= shared.BATCH_BYTES))
    assert ended and all(x == (1, True) for x in ended), ended
    assert out.count() == docs.count()


def test_nulls_repeats_empty_tables_and_extra_columns(spark, tmp_path):
    """A null text and an empty one stay, repeated rows are copies of which the rows of the smallest id stay, no rows give no rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.orderBy("doc_id").limit(40)
    kind = docs.schema
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "word " * 60_000, "en", "s", 300_000), (None, "text of a row without an id", "en", "s", 27)], kind)
    rows = one.union(one.limit(1)).union(odd).withColumn("toxicity", F.lit("x")).withColumn("component_id", F.lit(1)).withColumn("token_ids", F.lit(2))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, SF)
        assert stage(spark, rows.limit(0), SF).count() == 0
        out.write.parquet(f"{tmp_path}/{i}")
        rows = spark.read.parquet(f"{tmp_path}/{i}")
        ids = {r["doc_id"] for r in rows.select("doc_id").collect()}
        assert {900001, 900002, 900003, None} <= ids, name
        assert rows.columns == (docs.columns if i < len(corpus_pipeline.STAGES) - 1 else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"])


def test_eleven_queries():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
