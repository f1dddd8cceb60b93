"""Vectors, urls, language model, decontamination, classifiers and the pipeline against brute force on small fixtures."""

import itertools
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from breakwater.llm import decontaminate, lm, quality, queries, rabitq, shared, toxicity, url_tree, zdict


def brute_vectors(rows, cosine):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            good[i] = x / np.linalg.norm(x)
    links = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine] for i in good}
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(links.get(i, ())), min(ids) if ids else None))
    return sorted(out, key=repr)


def vectors(n=300, d=24):
    r = np.random.default_rng(5)
    rows = [(int(i), r.standard_normal(d).tolist()) for i in range(n)]
    for i in range(120):
        base = np.array(rows[int(r.integers(0, 30))][1])
        rows.append((1000 + i, (base + r.standard_normal(d) * r.choice([0.05, 0.2, 0.5])).tolist()))
    rows += [(2000, None), (2001, []), (2002, [0.0] * d), (2003, [float("nan")] * d), (2004, [1.0] * (d - 1) + [float("inf")]), (2005, [None] + [1.0] * (d - 1)), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[3][1]), rows[4], rows[4], (2008, [x * 1e200 for x in rows[5][1]])]
    return rows


@pytest.mark.parametrize("tile", [1500, 6])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(rabitq, "TILE", tile)
    monkeypatch.setattr(shared, "HOT_ROWS", tile)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node long, unit string")
    got = sorted(map(tuple, rabitq.near_vectors(df).collect()), key=repr)
    assert got == brute_vectors(rows, 0.95)
    assert rabitq.near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r, d = np.random.default_rng(1), 64
    x, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (r.standard_normal((2000, d)), r.standard_normal((2000, d))))
    turn = rabitq.rotation(d)
    a, b = x @ turn, q @ turn
    f = np.abs(a).sum(axis=1) / math.sqrt(d)
    error = ((np.where(a >= 0, 1, -1) / math.sqrt(d) * b).sum(axis=1)) / f - (x * q).sum(axis=1)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= rabitq.CONFIDENCE * np.sqrt((1 - f**2) / f**2 / (d - 1))).mean() > 0.999


def test_host_path_and_rules(spark):
    urls = ["HTTP://Www.Example.COM/en/700?x#y", "https://a.example.net/de/81", "https://a.example.net/de/71", "x://example.org/es/", "http://example.com#/en/7", "http://example.com?/en/7", "no url", None, "", "://", "http://notexample.com/en/7", "http://com/en/x", "http://é.com/en/", "http://a.net", "http://a.net/de", "u://h\n.com/en/a\nb?c"]

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
            tail = rest[k:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        best = None
        for kind, rule in queries.RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = kind, rule
        return host, path, best and best[1], best and best[0]

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_tree.judge(df, queries.RULES).collect():
        host, path, rule, verdict = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("block", "allow")
    assert url_tree.judge(df.limit(0), queries.RULES).count() == 0


@pytest.mark.parametrize("hot", [10_000, 1])
def test_templates(spark, monkeypatch, hot):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    monkeypatch.setattr(shared, "HOT_KEYS", 10_000)
    r = random.Random(1)
    rows = [f"http://shop.com/en/{i}" for i in range(40)] + [f"http://shop.com/fr/{i}" for i in range(40)] + [f"http://blog.com/posts/{'%x' % r.getrandbits(60)}/{w}" for w in ("a", "b")] * 10
    rows += [f"http://wiki.com/w/{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(50)]
    got = url_tree.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), [("block", "shop.com/en/1"), ("block", "shop.com/en/2"), ("allow", "shop.com/fr/1"), ("allow", "shop.com/fr/2")])
    by = {x["template"]: x for x in got.collect() if x["rule"] is None}
    assert by["/en/<num>"]["verdict"] == "block" and by["/fr/<num>"]["verdict"] == "allow"
    assert "/w/*" in by and by["/w/*"]["verdict"] == "allow"
    assert "/posts/<hex>/a" in by


def brute_model(texts, learnt, order, priors):
    """(n_tokens, n_known, train_tokens, base, score) of each list of words by the recursion over histories."""
    counts = {}
    for t, ok in zip(texts, learnt):
        if ok:
            line = [None, *t]
            for i in range(1, len(line)):
                for k in range(min(i + 1, order) if order > 1 else 1):
                    g = tuple(line[i - k : i + 1])
                    counts[g] = counts.get(g, 0) + 1
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def p(w, h):
        if not h:
            return (counts.get((w,), 0) + 0.5) / (n + 0.5 * (v + 1))
        have = counts.get(h, 0)
        return (counts.get((*h, w), 0) + priors[len(h) - 1] * p(w, h[1:])) / (have + priors[len(h) - 1]) if have else p(w, h[1:])

    out = []
    for t in texts:
        line = [None, *t]
        model = sum(math.log10(p(line[i], tuple(line[max(0, i - order + 1) : i]))) for i in range(1, len(line)))
        out.append((len(t), sum((w,) in counts for w in t), n, sum(math.log10(p(w, ())) for w in t), model))
    return out, p, {g[0] for g in counts if len(g) == 1}


@pytest.mark.parametrize("order,piece,block", [(1, 512, 1 << 24), (2, 7, 1 << 24), (3, 512, 1 << 24), (3, 5, 300), (4, 6, 1000)])
def test_language_model(spark, monkeypatch, order, piece, block):
    monkeypatch.setattr(lm, "PIECE", piece)
    monkeypatch.setattr(lm, "BLOCK", block)
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "<s>"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (102, " \n"), (103, "unseen words here"), (None, "w1 w2"), (104, "w1 w2 w3 " * 700)]
    rows += [rows[0], rows[1]]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    held = shared.crc_remainder(F.col("doc_id"), 5) == 1
    tokens = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w.decode()) for w in (t or "").encode().split()] + [None] for _, t in rows]
    learnt = [zlib.crc32(str("" if d is None else d).encode()) % 5 != 1 for d, _ in rows]
    want, p, known = brute_model(tokens, learnt, order, lm.PRIORS)
    by = lambda x: (repr(x[0]), x[1], round(x[4], 6))
    got = sorted(map(tuple, lm.score(df, ~held, order=order).collect()), key=by)
    want = sorted(((d, *w) for (d, _), w in zip(rows, want)), key=by)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    for a, b in zip(got, want):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert lm.score(df.limit(0), ~held).count() == 0
    # from each state the words' probabilities add up to 1
    for h in [(), (None,), ("w1",), (None, "w1"), ("w1", "w2")][: 1 + 2 * (order - 1)]:
        assert sum(p(w, h) for w in known) + p("no such word", h) == pytest.approx(1)


def test_language_model_without_training_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in lm.score(df, F.lit(False)).collect()}
    assert got[1]["score"] == got[1]["base_score"] == 0 and got[1]["n_tokens"] == 3 and got[2]["n_known"] == 0 == got[2]["train_tokens"]


def test_decontaminate(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + r.choice("klmn") + str.lower(r.choice("OPQR"))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(1, "A train from Paris to Lyon covers 120 km in 3 hours, and back from Lyon to Paris 120 km in 4 hours. How fast is it?"), (2, prose(30)), (3, "too short"), (4, None), (None, prose(12))]
    changed = "A train from Rome to Milan covers 480 miles in 6 hours, and back from Milan to Rome 480 miles in 8 hours. How fast is it?"
    mixed = "A train from Rome to Milan covers 480 miles in 6 hours, and back from Turin to Naples 99 miles in 8 hours. How fast is it?"
    near = items[1][1].split()
    near[12] = near[25] = "other"
    docs = [(10, prose(50) + " " + items[0][1] + " " + prose(20)), (11, prose(9) + "\n" + changed + " " + prose(9)), (12, prose(9) + " " + mixed), (13, items[1][1].upper()), (14, prose(8) + " " + " ".join(near)), (15, prose(300)), (16, None), (17, ""), (18, items[4][1]), (19, "  " + items[1][1] + "  "), (19, "  " + items[1][1] + "  "), (20, items[1][1] + " " + prose(5) + " " + items[1][1])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, at long, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.find(d, b).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2), (14, 2), (18, None), (19, 2), (20, 2)}
    assert got[10, 1]["kind"] == "exact" and got[11, 1]["kind"] == "parameters" and got[14, 2]["kind"] == "near"
    assert got[11, 1]["at"] == 9 and got[20, 2]["at"] == 0 and got[11, 1]["n_changed"] > 4
    left = decontaminate.decontaminate(d, b)
    assert {x["doc_id"] for x in left.collect()} == {12, 15, 16, 17} and left.columns == d.columns
    long = prose(20_000) + " " + items[1][1]
    assert [x["at"] for x in decontaminate.find(spark.createDataFrame([(1, long)], "doc_id long, text string"), b).collect()] == [20_000]
    assert decontaminate.find(d.limit(0), b).count() == 0 and decontaminate.find(d, b.limit(0)).count() == 0


def test_decontaminate_with_rows_of_numbers(spark):
    """Hits grow with documents and items, not with their product, and numbers as written are found."""
    r = random.Random(5)
    numbers = lambda n: " ".join(str(r.randrange(10_000_000)) for _ in range(n))

    def hits(n):
        items = spark.createDataFrame([(i, f"the sum of all of these {numbers(20)} is what we ask") for i in range(n)], "item_id long, text string")
        docs = spark.createDataFrame([(i, numbers(60)) for i in range(n)], "doc_id long, text string")
        items = items.select("item_id", F.col("text").alias("item_text"), decontaminate.words(decontaminate.canonical(F.col("text"))).alias("item"), F.col("item_id").alias("key"))
        there = decontaminate._placed(items, 5)
        return decontaminate._hits(docs, there, 1, 5).count()

    assert hits(20) <= 20 and hits(60) <= 60
    plain = numbers(12)
    found = decontaminate.find(
        spark.createDataFrame([(1, f"{numbers(8)} {plain} {numbers(9)}"), (2, numbers(30)), (3, "what is " + plain)], "doc_id long, text string"),
        spark.createDataFrame([(1, plain)], "item_id long, text string"),
    )
    # a run of numbers is one slot, so the place is that of the document's whole run
    assert sorted((x["doc_id"], x["at"]) for x in found.collect()) == [(1, 0), (3, 2)]


def test_decontaminate_over_offsets(spark):
    """Slots whose values have another number of words, and a word put in or left out in the middle."""
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    plain = prose(10)
    w = plain.split()
    asked = "when Anna walked for 5km along the old canal path she met Paul near a mill that was 1000 years old"
    items = [(1, asked), (2, plain), (3, prose(8))]
    docs = [
        (1, prose(9) + " " + asked.replace("Anna", "Mary Ann").replace("5km", "7 km").replace("1000", "2 500") + " " + prose(9)),
        (2, prose(9) + " " + asked.replace("Paul", "John Paul Peter") + " " + prose(9)),
        (3, prose(7) + " " + " ".join([*w[:5], "extra", *w[5:]]) + " " + prose(7)),
        (4, prose(7) + " " + " ".join([*w[:3], "extra", *w[3:]]) + " " + prose(7)),
        (5, prose(7) + " " + " ".join([*w[:7], *w[8:]]) + " " + prose(7)),
        (6, prose(7) + " " + " ".join(w[:5]) + " " + prose(40) + " " + " ".join(w[5:])),
        (7, prose(7) + " " + " ".join([*w[:5], *prose(3).split(), *w[8:]])),
        (8, plain + " " + plain),
    ]
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (8, 2)}
    assert [got[k]["kind"] for k in sorted(got)] == ["parameters", "parameters", "near", "near", "near", "exact"]
    assert [got[k]["at"] for k in sorted(got)] == [9, 9, 7, 7, 7, 0]
    assert got[4, 2]["n_equal"] == got[4, 2]["n_words"] == 10 and got[5, 2]["n_equal"] == 9
    assert got[1, 1]["n_slots"] == 4 and got[1, 1]["n_changed"] == 3


def test_decontaminate_with_slots_that_do_not_map(spark):
    """One edited value of a verbatim passage; two values that become equal; values with no mapping are not found."""
    twice = "take 120 pieces and put them in a box then lift it by 3 steps and count the 120 pieces once more before you close the lid"
    plain = "a shop sells 3 pears and buys 5 plums from Anna every morning while Paul keeps the books of the whole trade"
    dense = "from Paris to Lyon then 7 miles to Paris then Lyon then 7 miles to Paris or Lyon"
    docs = [
        (1, "so here we go again " + twice.replace("120 pieces once", "121 pieces once")),
        (2, "so here we go again " + plain.replace("3", "4").replace("5", "4")),
        (3, "so here we go again " + plain.replace("3", "4").replace("5", "4").replace("Anna", "Rita").replace("Paul", "Rita")),
        (4, "so here we go again from Rome to Oslo then 8 miles to Bonn then Kiel then 9 miles to Nice or Metz"),
    ]
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, twice), (2, plain), (3, dense)], "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): (x["kind"], x["n_changed"]) for x in found} == {(1, 1): ("parameters", 1), (2, 2): ("parameters", 2), (3, 2): ("parameters", 4)}


def labelled(spark, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["tion", "re", "ing", "er", "st", "ou", "an", "le"]) for _ in range(r.randint(1, 3)))
    docs, labels = [], []
    for i in range(600):
        w = [word() for _ in range(r.randint(30, 200))]
        toxic, bad = i % 3 == 0, i % 2 == 0
        if toxic:
            for _ in range(r.randint(2, 6)):
                w.insert(r.randrange(len(w)), r.choice(["grumblefix", "zorkhead", "blatch"]))
        t = " ".join(x + "###" for x in w) if bad else " ".join(w)
        docs.append((i, t, 1, "x"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, 1, "x"), (1001, "", 1, "x"), (1002, "x" * 50_000, 1, "x"), (5, docs[5][1], 1, "x")]
    labels += [(7, None, None), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, n long, y string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.95), (quality, "quality", 0.95)])
def test_classifiers_on_held_out_rows(spark, module, label, least):
    docs, labels = labelled(spark)
    held = shared.crc_remainder(F.col("doc_id"), 4) == 2
    model = module.fit(docs, labels.where(~held))
    scored = module.score(docs, model)
    assert scored.columns == ["doc_id", "n", "y", "score"]
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= x["score"] <= 1 for x in rows)
    test = [((x["score"] >= module.THRESHOLD) == bool(truth[x["doc_id"]])) for x in rows if x["doc_id"] in truth and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2 and truth[x["doc_id"]] is not None]
    assert np.mean(test) >= least
    assert module.score(docs.limit(0), model).count() == 0
    none = module.fit(docs, labels.limit(0))
    assert all(0 <= x["score"] <= 1 for x in module.score(docs.limit(5), none).collect())


def test_toxicity_needs_both_dictionaries(spark):
    """Both dictionaries hold text of their own; without the toxic one's, or with both alike, classes are not told apart."""
    docs, labels = labelled(spark)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = [(texts[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in texts and r["toxic"] is not None and r["doc_id"] < 1000]
    y = np.array([c for _, c in rows])
    model = toxicity.learn([t for t, _ in rows[::2]], y[::2])
    assert len(model.yes) > 1000 and len(model.no) > 1000
    common = os.path.commonprefix([model.yes, model.no])
    assert len(model.yes) - len(common) >= 64 and len(model.no) - len(common) >= 64

    def gap(m):
        s = np.concatenate([m.scores(data, bounds) for _, _, data, bounds in zdict.texts_in_pieces([t for t, _ in rows[1::2]])])
        return s[y[1::2] == 1].mean() - s[y[1::2] == 0].mean()

    assert gap(model) > 0.7
    assert gap(toxicity.Model(common, model.no, model.weights)) < 0.2
    assert gap(toxicity.Model(model.yes, model.yes, model.weights)) < 0.2


def test_small_batches(spark):
    """Batches are small within a write, and the session's setting is as before after it, also after an error."""
    key = shared._BATCH
    was = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    texts = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    assert shared.saved(texts.mapInArrow(sizes, "n long")).agg(F.max("n")).first()[0] < 200
    assert spark.conf.get(key) == was
    with pytest.raises(ValueError), shared.small_batches(spark):
        raise ValueError
    assert spark.conf.get(key) == was


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, r.randrange(101, 140)) for _ in range(30)] + [(200, 200), (None, 3), (5, None)]
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(31)) and got[200] == 200 and all(c == 100 for n, c in got.items() if 100 <= n < 200)
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def joined_rows(spark, run):
    """Rows that the joins of all executions within `run` made."""
    store = spark._jsparkSession.sharedState().statusStore()
    rows = lambda seq: [seq.apply(i) for i in range(seq.size())]
    ids = lambda: {x.executionId() for x in rows(store.executionsList())}
    before = ids()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = 0
    for k in ids() - before:
        values = store.executionMetrics(k)
        for node in rows(store.planGraph(k).allNodes()):
            for m in rows(node.metrics()):
                if "Join" in node.name() and m.name() == "number of output rows" and (got := values.get(m.accumulatorId())).isDefined():
                    total += int(got.get().replace(",", ""))
    return total


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_make_few_rows(spark, monkeypatch, few):
    """Groups whose members all link, in a row: joins make a few rows for each edge, however many rounds it takes."""
    monkeypatch.setattr(shared, "FEW", few, raising=False)
    r = random.Random(2)
    ids = r.sample(range(1 << 40), 40 * 60)
    groups = [ids[i : i + 40] for i in range(0, len(ids), 40)]
    edges = [(a, b) for g in groups for a, b in itertools.combinations(g, 2)] + [(g[0], h[-1]) for g, h in itertools.pairwise(groups)]
    frame = spark.createDataFrame(edges, "a long, b long").cache()
    frame.count()
    got = []
    made = joined_rows(spark, lambda: got.extend(shared.components(frame).collect()))
    assert sorted(x["node"] for x in got) == sorted(ids) and {x["component"] for x in got} == {min(ids)}
    assert 0 < made < 4 * len(edges)
