"""Thin queries of the ten operators and of the pipeline: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm import bpe, decontaminate, jaccard, line_windows, lm, quality, rabitq, repeats, toxicity, url_tree
from breakwater.llm.shared import crc_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = table(spark, sf_dir, "labels").where(crc_remainder(F.col("doc_id"), 4) != 2)
    scored = quality.score(docs, quality.fit(docs, seen))
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_windows.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return digests(bpe.decode(coded, ranks))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge(table(spark, sf_dir, "pages"), RULES).drop("purity")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = table(spark, sf_dir, "labels").where(crc_remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, seen))
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), "0.9", 3)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_remainder(F.col("doc_id"), 5) == 1
    scored = lm.score(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("mean_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_line_dedup, op4_bpe, op5_repeats, op6_vectors, op7_urls, op8_toxicity, op9_jaccard, op10_lm)}


_LINES = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
p AS (SELECT doc_id, text, x, unnest(range(1, len(x) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, x[i] || chr(10) || x[i + 1] || chr(10) || x[i + 2] AS v FROM p
      WHERE i + 2 <= len(x) AND (trim(x[i], ' ') <> '' OR trim(x[i + 1], ' ') <> '' OR trim(x[i + 2], ' ') <> '')),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(range(0, 3)) AS j) WHERE k > 1),
s AS (SELECT p.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(p.x[p.i], chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM s
"""


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, vec_id = m.c AS kept FROM embeddings JOIN m ON vec_id = m.n LEFT JOIN k ON vec_id = k.a
"""

_SHINGLES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
  ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id AS n, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents AS d JOIN m ON d.doc_id = m.n LEFT JOIN n ON d.doc_id = n.doc_id
"""


def _url_sql() -> str:
    """The url tree's steps, level by level."""
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    fits = {n: f"(host = '{n.partition('/')[0]}' OR ends_with(host, '.{n.partition('/')[0]}')) AND starts_with(path, '/{n.partition('/')[2]}')" for _, n in RULES}
    rule = "CASE " + " ".join(f"WHEN {fits[n]} THEN '{n}'" for _, n in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN rule = '{n}' THEN '{k}'" for k, n in longest) + " END"
    number = r"regexp_replace(regexp_replace(lower(x), '^\d{4}-\d{1,2}(-\d{1,2})?(\.[a-z]{1,5})?$', '<date>\2'), '^\d+(\.[a-z]{1,5})?$', '<num>\1')"
    typed = r"CASE WHEN regexp_matches(" + number + r", '^[a-f]*\d') AND regexp_matches(" + number + r", '^[0-9a-f-]{8,}(\.[a-z]{1,5})?$') THEN regexp_replace(" + number + r", '^[0-9a-f-]{8,}', '<hex>') ELSE " + number + " END"
    parts = [
        f"""a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {rule} AS rule FROM b),
e AS (SELECT *, {ruled} AS ruled, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {typed}) AS segments FROM c),
t0 AS (SELECT host, segments, count(*) AS n, count(ruled) AS known, count(*) FILTER (WHERE ruled = 'block') AS blocked, '' AS template FROM e GROUP BY host, segments)"""
    ]
    for i in range(url_tree.LEVELS):
        parts.append(
            f"""v{i} AS (SELECT host, template, segments[{i + 1}] AS s, sum(n) AS n FROM t{i} WHERE len(segments) > {i} GROUP BY ALL),
w{i} AS (SELECT host, template, true AS wide FROM v{i} GROUP BY host, template HAVING count(*) >= {url_tree.VALUES} AND count(*) >= {url_tree.VARIETY} * sum(n)),
t{i + 1} AS (SELECT host, segments, n, known, blocked, template || CASE WHEN len(segments) <= {i} THEN '' WHEN starts_with(segments[{i + 1}], '<') THEN '/' || segments[{i + 1}] WHEN wide THEN '/*' ELSE '/' || segments[{i + 1}] END AS template FROM t{i} LEFT JOIN w{i} USING (host, template))"""
        )
    k, z, a = url_tree.SMOOTHING, url_tree.Z, url_tree.LEVELS
    parts.append(
        f"""u AS (SELECT host, segments, known, blocked, template || CASE WHEN len(segments) > {a} THEN '/**' ELSE '' END AS template FROM t{a}),
s AS (SELECT *, array_to_string(list_transform(string_split(template, '/'), lambda x: CASE WHEN x = '' OR x[1] IN ('<', '*') THEN x ELSE 'word' END), '/') AS shape FROM u),
g AS (SELECT (coalesce(sum(blocked), 0) + 0.5::DOUBLE) / (coalesce(sum(known), 0) + 2.0::DOUBLE) AS prior FROM s),
h AS (SELECT host, (sum(blocked) + {k}::DOUBLE * any_value(prior)) / (sum(known) + {k}::DOUBLE) AS host_rate FROM s, g GROUP BY host),
f AS (SELECT host, shape, sum(known) AS shape_known, sum(blocked) AS shape_blocked, (sum(blocked) + 0.5::DOUBLE) / (sum(known) + 1.0::DOUBLE) AS pooled FROM s GROUP BY host, shape),
m AS (SELECT host, shape, template, sum(known) AS own_known, sum(blocked) AS own_blocked FROM s GROUP BY ALL),
o AS (SELECT m.host, template, host_rate, CASE WHEN abs(own_blocked - own_known * pooled) > {z}::DOUBLE * sqrt(own_known * pooled * (1 - pooled)) THEN own_known ELSE shape_known END AS known,
  CASE WHEN abs(own_blocked - own_known * pooled) > {z}::DOUBLE * sqrt(own_known * pooled * (1 - pooled)) THEN own_blocked ELSE shape_blocked END AS blocked
  FROM m JOIN f USING (host, shape) JOIN h ON m.host = h.host),
q AS (SELECT u.host, u.segments, u.template, o.known > 0 AND (o.blocked + {k}::DOUBLE * o.host_rate) / (o.known + {k}::DOUBLE) >= {url_tree.REJECT} AS bad FROM u JOIN o ON u.host = o.host AND u.template = o.template)
SELECT page_id, e.host, path, rule, coalesce(ruled, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, template FROM e JOIN q ON e.host = q.host AND e.segments = q.segments"""
    )
    return "WITH " + ",\n".join(parts)


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _LINES, "op6_vectors": _VECTORS, "op7_urls": _url_sql(), "op9_jaccard": _SHINGLES}
