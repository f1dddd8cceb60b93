"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts are canonicalised word by word: a number becomes <num> (with the unit
or percent sign that is written to it), a unit after a number <unit>, a
capitalised word inside a sentence <name>; other words lose their case and
outer punctuation. Every window of `WIDTH` canonical words of a document is
hash-joined with the benchmark items' windows, and so is every window of `WIDTH`
words and runs, a run being names in a row or numbers in a row with their units. A
window of placeholders alone proposes nothing, since it stands wherever numbers or names
do; where it is of words, its words as written make a window in its place.
Hits propose that the item stands in the document at a certain place; there it is
aligned, in words and runs, over the offsets of all hits nearby (no further apart
than the words that may differ) and two more on either side. The item is found where
`SIMILARITY` of its canonical words agree and either as many of its words agree as
written or the placeholders are filled consistently: of all slots, `SIMILARITY` have the
value that is the most frequent one in the document for their value in the item.
Different values may become equal. So a question that only had its numbers, names or
units exchanged is found and told from an exact copy.

Items of fewer than `WIDTH` words match nothing. Null and empty texts match
nothing. An item with a null item_id takes part. Repeated rows are reported
once each per distinct (doc_id, text). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.llm.shared import saved, small

WIDTH, SIMILARITY = 5, 0.8
#: Units that follow a number.
UNITS = "mm|cm|dm|m|km|in|ft|yd|mi|mile|miles|mg|g|kg|t|lb|lbs|oz|ml|l|s|sec|seconds|min|minutes|h|hr|hours|day|days|week|weeks|month|months|year|years|mph|kmh|km/h|m/s|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|kwh|j|kj|cal|kcal|v|a|pa|kpa|bar|k|usd|eur|gbp|dollars|euros|pounds|cents|percent|degrees"
_EDGE = r"\p{P}\p{S}"


def canonical(text: Column) -> Column:
    """The text with typed placeholders, as many words as before, lower-cased (an expression on the whole text)."""
    x = F.concat(F.lit(" "), F.regexp_replace(text, r"\s+", " "), F.lit(" "))
    # a capitalised word is a name unless it begins a sentence
    x = F.regexp_replace(x, r"(?<=[\p{L}\p{N},;:'’)] )\p{Lu}\p{Ll}[\p{L}'’-]*", "<name>")
    x = F.regexp_replace(x, rf"(?<= )[{_EDGE}&&[^<]]*\p{{N}}[^ ]*", "<num>")
    x = F.regexp_replace(F.lower(x), rf"(?<=<num> )(?:{UNITS})(?=[{_EDGE}]* )", "<unit>")
    return F.regexp_replace(x, rf"(?<= )[{_EDGE}&&[^<]]+(?=[^ ])|(?<=[^ ])[{_EDGE}&&[^>]]+(?= )", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def raw_words(text: Column) -> Column:
    """The words of the text as written, one for each canonical word."""
    return words(F.regexp_replace(text, r"\s+", " "))


def _tokens(df: DataFrame, source: str, begin: str, hashed: bool = False) -> DataFrame:
    """`df` with `begin`: the indices of the words of `source` at which a word or a run of placeholders begins, and the number of words at the end.

    Names in a row are a run, and so are numbers in a row with their units.
    """
    name, num, unit = (F.xxhash64(F.lit(x)) if hashed else F.lit(x) for x in ("<name>", "<num>", "<unit>"))
    w, n = F.col(source), F.size(source)
    goes_on = F.filter(F.sequence(F.lit(1), n - 1), lambda i: (F.get(w, i) == F.get(w, i - 1)) & F.get(w, i).isin(name, num) | (F.get(w, i) == unit) & F.get(w, i - 1).isin(num, unit) | (F.get(w, i) == num) & (F.get(w, i - 1) == unit))
    df = df.withColumn("__on", F.when(n > 1, goes_on).otherwise(F.array().cast("array<int>")))
    return df.withColumn(begin, F.array_except(F.sequence(F.lit(0), n), "__on")).drop("__on")


def _windows(df: DataFrame, width: int, text: str) -> DataFrame:
    """`df` with `windows`, (p, w) for each window of its hashes `h`: of `width` words, and of `width` words and runs where a run is longer than a word.

    Windows of nothing but placeholders are alike wherever numbers or names
    stand in a row. Beside one that is of words stands another one, of its
    words as written.
    """
    n, h, begin = F.size("h") - width, F.col("h"), F.col("begin")
    plain = F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice(h, i + 1, width)).alias("w"))))
    last = F.size("begin") - 1 - width
    long = F.filter(F.sequence(F.lit(0), last), lambda c: F.get(begin, c + width) - F.get(begin, c) > width)
    # exploded by explode_outer, which puts no filter of this expression below
    df = df.withColumn("long", F.when((last >= 0) & (F.size("begin") <= F.size("h")), long))
    runs = F.transform("long", lambda c: F.struct(F.get(begin, c).alias("p"), F.xxhash64(F.transform(F.slice(begin, c + 1, width), lambda i: F.get(h, i))).alias("w")))
    every = F.when(F.size(F.coalesce("long", F.array().cast("array<int>"))) > 0, F.concat(plain, runs)).otherwise(plain)
    # a character for each word, so that a text without windows of placeholders is told by one search, if it has any
    some = F.arrays_overlap("h", F.array(*_slots())) & (F.instr(F.array_join(F.transform("h", lambda x: F.when(x.isin(*_slots()), "1").otherwise("0")), ""), "1" * width) > 0)
    full = lambda i: F.forall(F.slice(h, i + 1, width), lambda x: x.isin(*_slots()))
    # by way of an array, so that the words are split once
    written = F.flatten(F.transform(F.array(raw_words(F.lower(F.col(text)))), lambda raw: F.transform(F.filter(F.sequence(F.lit(0), n), full), lambda i: F.struct(i.alias("p"), F.xxhash64(F.lit("written"), F.slice(raw, i + 1, width)).alias("w")))))
    return df.withColumn("windows", F.when(some, F.concat(every, written)).otherwise(every))


def _slots() -> list[Column]:
    return [F.xxhash64(F.lit(x)) for x in ("<name>", "<num>", "<unit>")]


def _aligned(item: Column, weight: Column, doc: Column, near: Column, lo: Column) -> Column:
    """(score, path) of the item's best alignment: path has the offset at which each word of the item has its equal, null for none.

    `near` are offsets in a row. An offset may rise (words of the document
    between the item's) and may fall by one for each word of the item that is
    passed over, so no word serves twice. Equal words count first, few words
    in between next.
    """

    def step(state, i):
        def cell(k, x):
            equal = F.get(item, i) == F.get(doc, i + k - lo)
            stay = F.transform(F.slice(state, 1, x + 1), lambda c, y: F.struct((c["score"] - (x - y) + F.when(equal, 100 * F.get(weight, i)).otherwise(0)).alias("score"), F.lit(1).alias("stay"), c["path"].alias("path")))
            over = F.get(state, x + 1)
            best = F.array_max(F.concat(stay, F.array(F.struct(over["score"].alias("score"), F.lit(0).alias("stay"), over["path"].alias("path")))))
            # by way of an array, so that it is evaluated once
            return F.get(F.transform(F.array(best), lambda c: F.struct(c["score"].alias("score"), F.array_append(c["path"], F.when((c["stay"] == 1) & equal, k)).alias("path"))), F.lit(0))

        return F.transform(near, cell)

    start = F.transform(near, lambda k: F.struct(F.lit(0).alias("score"), F.array().cast("array<int>").alias("path")))
    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, step, lambda state: F.array_max(state))


def _placed(items: DataFrame, width: int) -> DataFrame:
    """(w, key, q): where each window that proposes an item stands in it; those of placeholders alone propose nothing."""
    hashed = _windows(_tokens(items.select("key", "item_text", F.transform("item", lambda w: F.xxhash64(w)).alias("h")), "h", "begin", True), width, "item_text")
    placed = hashed.select("key", F.explode_outer("windows").alias("t")).select("t.w", "key", F.col("t.p").alias("q")).distinct()
    # every sequence of `width` placeholders, by its hash
    idle: list[list[Column]] = [[]]
    for _ in range(width):
        idle = [[*x, k] for x in idle for k in _slots()]
    return placed.where(~F.col("w").isin(*(F.xxhash64(F.array(*x)) for x in idle)))


def _hits(named: DataFrame, there: DataFrame, count: int, width: int) -> DataFrame:
    """(doc_id, part, p, key, q): the windows of documents that stand in items."""
    here = named.select("doc_id", "text", F.xxhash64("text").alias("part"), F.transform(words(canonical(F.col("text"))), lambda w: F.xxhash64(w)).alias("h"))
    here = _windows(_tokens(here, "h", "begin", True), width, "text").select("doc_id", "part", F.explode_outer("windows").alias("t")).select("doc_id", "part", "t.p", "t.w")
    return here.join(small(there, count), "w").select("doc_id", "part", "p", "key", "q")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, at, n_words, n_equal, n_slots, n_changed, kind): where items stand in documents.

    `at` counts words from 0. A run of placeholders is one slot; n_words and
    n_equal count the item's words in it. kind is "exact" if all words are as
    in the item, "parameters" if only slots' values differ, else "near". Of an
    item's places in a document that with the most equal words is given, the
    first of equals.
    """
    items = benchmark.select("item_id", F.col("text").alias("item_text")).distinct()
    items = items.select("item_id", "item_text", words(canonical(F.col("item_text"))).alias("item"), raw_words(F.col("item_text")).alias("item_raw")).where(F.size("item") >= width)
    items = items.withColumn("key", F.xxhash64("item_id", F.array_join("item_raw", " ")))
    there = saved(_placed(items, width))
    count = there.count()
    # an item's texts: as written, canonical, and what is made of them
    facts = items.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.length("item_text")), F.lit(0.0))).first()
    items = items.drop("item_text")
    item_bytes = 64 + 8 * int(facts[1])

    named = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    hits = _hits(named, there, count, width)
    starts = hits.groupBy("doc_id", "part", "key", (F.col("p") - F.col("q")).alias("at")).agg(F.min("p").alias("first"), F.max("p").alias("last"))
    starts = saved(starts.groupBy("doc_id", "part").agg(F.collect_list(F.struct("key", "at", "first", "last")).alias("starts")))

    # the words at those places, from the texts again
    size = starts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    found = small(starts.withColumnRenamed("doc_id", "id"), size[0] + size[1])
    again = named.withColumn("hash", F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("part"))).dropDuplicates(["doc_id", "part"])
    again = again.select("doc_id", "part", words(canonical(F.col("text"))).alias("doc"), raw_words(F.col("text")).alias("doc_raw"), "starts")
    again = _tokens(again, "doc", "begin").withColumn("key", F.explode_outer(F.array_distinct("starts.key")))
    wide = _tokens(items, "item", "item_begin").withColumn("n", F.size("item_begin") - 1)
    lengths = wide.select("key", "item_begin", "n")
    # hits' offsets, counted in words and runs
    place = lambda begin, p: F.size(F.filter(begin, lambda b: b <= p))
    offset = lambda p, at: place(F.col("begin"), p) - place(F.col("item_begin"), p - at)
    offsets = F.transform(F.filter("starts", lambda s: s["key"] == F.col("key")), lambda s: F.array(offset(s["first"], s["at"]), offset(s["last"], s["at"])))
    facing = again.join(small(lengths, facts[0], item_bytes), "key").withColumn("offsets", F.array_distinct(F.flatten(offsets)))
    facing = facing.withColumn("band", F.greatest(F.lit(2), F.floor((1 - similarity) * F.col("n") + 1e-9).cast("int"))).withColumn("a", F.explode_outer("offsets"))
    close = F.filter("offsets", lambda o: F.abs(o - F.col("a")) <= F.col("band"))
    facing = facing.withColumns({"low": F.array_min(close) - 2, "high": F.array_max(close) + 2})
    facing = facing.withColumns({"lo": F.greatest("low", F.lit(0)), "hi": F.least(F.col("high") + F.col("n"), F.size("begin") - 1)})
    # only the words that may face the item travel on
    first = F.get("begin", "lo")
    facing = facing.where("lo < hi").select(
        "doc_id", "part", "key", "a", "low", "high", "lo", F.slice("begin", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1).alias("begin"), F.slice("doc", first + 1, F.get("begin", "hi") - first).alias("doc"), F.slice("doc_raw", first + 1, F.get("begin", "hi") - first).alias("doc_raw")
    )
    both = facing.join(small(wide, facts[0], item_bytes), "key")
    begin, item_begin, lo = F.col("begin"), F.col("item_begin"), F.col("lo")
    raw = lambda text, at, i: _bare(F.array_join(F.slice(text, F.get(at, i) - F.get(at, F.lit(0)) + 1, F.get(at, i + 1) - F.get(at, i)), " "))
    both = both.withColumns({"n_words": F.size("item"), "item": F.transform(F.slice("item_begin", F.lit(1), F.col("n")), lambda b: F.get("item", b)), "weight": F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(item_begin, i + 1) - F.get(item_begin, i)), "doc": F.transform(F.slice(begin, F.lit(1), F.size(begin) - 1), lambda b: F.get("doc", b - F.get(begin, F.lit(0))))})
    both = both.where(F.size(F.array_except("item", "doc")) <= F.col("n_words") - F.ceil(F.col("n_words") * similarity))
    whole = (F.col("a") >= lo) & (F.slice("doc", F.greatest(F.col("a") - lo, F.lit(0)) + 1, F.col("n")) == F.col("item"))
    both = both.withColumn("near", F.when(whole, F.array("a")).otherwise(F.sequence("low", "high")))
    # tables are written where filters pushed down would repeat what is costly
    both = saved(both)
    both = both.withColumn("path", _aligned(F.col("item"), F.col("weight"), F.col("doc"), F.col("near"), lo)["path"])
    both = saved(both.drop("doc", "near"))
    faced = F.transform("path", lambda k, i: F.struct(i.alias("i"), k.alias("k"), F.get("item", i).alias("a"), F.get("weight", i).alias("words")))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, t: s + t["words"])
    both = both.withColumn("faced", F.filter(faced, lambda t: t["k"].isNotNull())).withColumn("n_equal", total(F.col("faced"))).where(F.col("n_equal") >= F.ceil(F.col("n_words") * similarity))
    slot = F.filter("faced", lambda t: t["a"].isin("<num>", "<name>"))
    slots = F.transform(slot, lambda t: F.struct(raw(F.col("item_raw"), item_begin, t["i"]).alias("x"), raw(F.col("doc_raw"), begin, t["i"] + t["k"] - lo).alias("y"), t["words"].alias("words")))
    both = saved(both.select("doc_id", "part", "item_id", F.get(begin, F.greatest(F.get("faced", F.lit(0))["k"] - lo, F.lit(0))).alias("at"), "n_words", "n_equal", (F.size(F.array_distinct("faced.k")) > 1).alias("moved"), slots.alias("slots")))
    both = both.withColumn("changed", F.filter("slots", lambda t: t["x"] != t["y"]))
    # of each value of the item, how many slots have its most frequent value in the document
    kept = F.transform(F.array_distinct("slots.x"), lambda x: F.array_max(F.transform(F.array_distinct("slots.y"), lambda y: F.size(F.filter("slots", lambda t: (t["x"] == x) & (t["y"] == y))))))
    constant = F.aggregate(kept, F.lit(0), lambda s, n: s + n) >= F.ceil(F.size("slots") * similarity)
    verbatim = F.col("n_equal") - F.aggregate("changed", F.lit(0), lambda s, t: s + t["words"]) >= F.ceil(F.col("n_words") * similarity)
    both = both.withColumn("consistent", constant | verbatim)
    result = both.select(
        "doc_id",
        "part",
        "item_id",
        "at",
        "n_words",
        "n_equal",
        F.size("slots").alias("n_slots"),
        F.size("changed").alias("n_changed"),
        "moved",
        "consistent",
    ).where("consistent")
    best = result.groupBy("doc_id", "part", "item_id").agg(F.min(F.struct((-F.col("n_equal")).alias("o"), "moved", "at", "n_words", "n_equal", "n_slots", "n_changed")).alias("r")).select("doc_id", "item_id", "r.at", "r.n_words", "r.n_equal", "r.n_slots", "r.n_changed", "r.moved")
    kind = F.when((F.col("n_equal") < F.col("n_words")) | F.col("moved"), "near").when(F.col("n_changed") > 0, "parameters").otherwise("exact")
    return best.withColumn("kind", kind).drop("moved")


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), rf"(?:^|(?<= ))[{_EDGE}]+|[{_EDGE}]+(?=$| )", "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """`docs` without those in which an item stands; rows with a null id are judged by their text alone."""
    found = saved(find(docs, benchmark, text, id_).select(F.col("doc_id").alias("__id")).distinct())
    return docs.join(small(found, found.count()), F.col(id_).eqNullSafe(F.col("__id")), "left_anti")
