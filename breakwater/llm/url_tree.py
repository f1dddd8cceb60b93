"""URL verdicts by rules and, beyond them, by a tree of path templates, in DataFrame operations only.

Every host has a tree of its paths' segments. Numbers, long hexadecimal
strings and dates become typed wildcards; level by level, a segment whose
parent has many different values for it becomes the wildcard `*`. Pages that a
rule decides are the labelled ones. Templates of a host that have the same
shape (only their fixed words differ) are merged unless their share of blocked
pages differs significantly from the shape's. A template's purity is its share
of blocked pages, smoothed towards its host's, which is smoothed towards that
of all. A template with labelled pages and a purity of `REJECT` or more is
blocked.

A url that is null or has no "://" has an empty host and path, which form a
template of their own. Repeated rows are judged each. Without labelled pages
nothing is blocked. Columns of the input other than the id and url are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.llm.shared import join_hot, saved, small

#: Levels of the tree; deeper segments are one tail wildcard.
LEVELS = 4
#: A level is variable if its parent has at least so many values, and so many for each page.
VALUES, VARIETY = 12, 0.3
SMOOTHING, Z, REJECT = 4.0, 1.96, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 2000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are (verdict, "host/path...")."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, tail = name.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def typed(segment: Column) -> Column:
    """Numbers, hexadecimal strings and dates as typed wildcards, a file ending kept."""
    x = F.lower(segment)
    x = F.regexp_replace(x, r"^\d{4}-\d{1,2}(-\d{1,2})?(?=\.[a-z]{1,5}$|$)", "<date>")
    x = F.regexp_replace(x, r"^\d+(?=\.[a-z]{1,5}$|$)", "<num>")
    return F.regexp_replace(x, r"^(?=[a-f]*\d)[0-9a-f-]{8,}(?=\.[a-z]{1,5}$|$)", "<hex>")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", id_: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row."""
    host, path = host_and_path(F.col(url))
    base = pages.select(F.col(id_).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), typed)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), segments.alias("segments"))
    label = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("long"))
    # pages of one host and one list of segments are one row of the tree
    tree = saved(base.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("known"), F.sum(label).alias("blocked")))
    tree = tree.withColumn("blocked", F.coalesce("blocked", F.lit(0))).withColumn("template", F.lit(""))
    for level in range(LEVELS):
        here = F.get("segments", F.lit(level))
        values = tree.where(here.isNotNull()).groupBy("host", "template", here.alias("s")).agg(F.sum("n").alias("n"))
        wide = values.groupBy("host", "template").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("pages")).where(F.col("values") >= VALUES).where(F.col("values") >= VARIETY * F.col("pages")).select("host", "template", F.lit(True).alias("wide"))
        # few parents are wide: by broadcast, a host of many pages is not gathered in one task
        wide = saved(wide)
        wide = small(wide, wide.count(), 96)
        segment = F.when(F.startswith(here, F.lit("<")), here).when(F.col("wide"), "*").otherwise(here)
        tree = tree.join(wide, ["host", "template"], "left").withColumn("template", F.when(here.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), segment))).drop("wide")
    tree = tree.withColumn("template", F.when(F.size("segments") > LEVELS, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
    tree = saved(tree.withColumn("shape", F.regexp_replace("template", r"(?<=/)[^/<*][^/]*(?=/|$)", "word")))

    sums = [F.sum("known").alias("known"), F.sum("blocked").alias("blocked")]
    every = tree.agg(*sums).select(((F.coalesce("blocked", F.lit(0)) + 0.5) / (F.coalesce("known", F.lit(0)) + 2.0)).alias("prior"))
    # a single row, so a broadcast of it is small at any size
    hosts = tree.groupBy("host").agg(*sums).join(F.broadcast(every)).select("host", ((F.col("blocked") + SMOOTHING * F.col("prior")) / (F.col("known") + SMOOTHING)).alias("host_rate"))
    shapes = tree.groupBy("host", "shape").agg(F.sum("known").alias("shape_known"), F.sum("blocked").alias("shape_blocked"))
    templates = tree.groupBy("host", "shape", "template").agg(*sums, F.count(F.lit(1)).alias("lists")).join(shapes, ["host", "shape"]).join(hosts, "host")
    pooled = (F.col("shape_blocked") + 0.5) / (F.col("shape_known") + 1.0)
    apart = F.abs(F.col("blocked") - F.col("known") * pooled) > Z * F.sqrt(F.col("known") * pooled * (1 - pooled))
    known, blocked = (F.when(apart, F.col(c)).otherwise(F.col(f"shape_{c}")) for c in ("known", "blocked"))
    purity = (blocked + SMOOTHING * F.col("host_rate")) / (known + SMOOTHING)
    templates = saved(templates.select("host", "template", purity.alias("purity"), known.alias("known"), "lists"))
    verdicts = saved(join_hot(tree.select("host", "segments", "template", "n"), templates, ["host", "template"], "lists"))
    told = F.when((F.col("known") > 0) & (F.col("purity") >= REJECT), "block").otherwise("allow")
    return join_hot(base, verdicts, ["host", "segments"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", told).alias("verdict"), "template", "purity")
