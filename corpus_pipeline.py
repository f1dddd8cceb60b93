"""A training corpus from `documents`: toxicity, line dedup, near duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
rows that its predecessor kept. All but the last return the columns of
`documents`. Stages read and write nothing but their tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm import bpe, decontaminate, jaccard, line_windows, queries, toxicity
from breakwater.llm.shared import saved, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold. It learns from all labels of `documents`."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    # texts don't come back from the scoring: the toxic ones go by id and hash
    part = F.xxhash64("text")
    scored = toxicity.score(docs.select("doc_id", part.alias("part"), "text"), model)
    gone = saved(scored.where(F.col("score") >= toxicity.THRESHOLD).select(F.col("doc_id").alias("id"), "part").distinct())
    return docs.join(small(gone, gone.count()), docs["doc_id"].eqNullSafe(gone["id"]) & (part == gone["part"]), "left_anti")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; a document that loses all its lines goes."""
    cut = line_windows.dedup_lines(docs.select(*COLUMNS))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates: five-word shingles, similarity 0.8."""
    classes = jaccard.near_duplicates(docs)
    gone = saved(classes.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, exact or with its parameters changed."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids) of each kept text; ids are little-endian unsigned 32-bit integers."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.round_trip(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    # written here: batches are small within this write, while the caller's may be of any size
    return saved(decoded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "token_ids"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", cut_lines), ("jaccard", keep_one), ("decontaminate", drop_leaks), ("bpe", tokenise)]

#: Toxicity scores and token ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the checkpoint folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
