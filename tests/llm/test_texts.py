"""The text operators against brute force on small fixtures with nulls, empties, copies, repeated rows and extra columns."""

import base64
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from breakwater.llm import bpe, jaccard, line_windows, repeats, shared

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("component", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("part", T.StringType())])


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], SCHEMA)


def prose(r, n):
    return " ".join(r.choice(["the", "of", "And", "tion", "re", "ing", "er", "st", "ou", "é"]) + r.choice(["ha", "nt", "ed", "or", ""]) + r.choice(["es", "ly", "", "x"]) for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    base = [prose(r, r.randint(5, 300)) for _ in range(30)]
    passage = prose(r, 120)
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for i in range(40):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    for i in range(15):
        at = r.randint(0, 40)
        rows.append((300 + i, prose(r, at) + " " + passage[: r.randint(300, len(passage))] + " " + prose(r, 30)))
    rows += [(400, None), (401, ""), (402, "  \n "), (403, "one"), (404, "One"), (405, "two words"), (406, "Nd, " * 300), (407, "Nd, " * 200 + "end"), (408, "a" * 2000)]
    rows += [rows[0], rows[3], (None, "lonely words of a null id"), (100, "another text of the same id " + prose(r, 80))]
    return rows


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("width,similarity,percent", [(3, "0.9", 90), (5, "0.8", 80), (3, "0.55", 55)])
def test_near_duplicates(spark, width, similarity, percent):
    rows = corpus(width)
    got = jaccard.near_duplicates(make(spark, rows), similarity, width).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, width, percent)


@pytest.mark.parametrize("tile,elements", [(4, 1 << 21), (4000, 300)])
def test_near_duplicates_in_tiles(spark, monkeypatch, tile, elements):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "ELEMENTS", elements)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    rows = corpus(9)
    got = jaccard.near_duplicates(make(spark, rows), "0.8", 3).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 3, 80)


@pytest.mark.parametrize("common", [3, 40])
def test_near_duplicates_among_texts_of_shared_passages(spark, monkeypatch, common):
    """Texts put together from the same passages are no block, and near copies among them are all found."""
    r = random.Random(11)
    passages = [" ".join(f"p{i}w{j}" for j in range(60)) for i in range(24)]
    rows = [(i, " ".join([*r.sample(passages, 4), prose(r, 10)])) for i in range(150)]
    for i in range(30):
        w = rows[i][1].split()
        for _ in range(r.randint(1, 8)):
            w[r.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w)))
    sizes, tiles = [], jaccard._tiles
    monkeypatch.setattr(jaccard, "_tiles", lambda got, sized, measure: sizes.extend(x["count"] for x in sized.groupBy("block").count().collect()) or tiles(got, sized, measure))
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "TILE", 20)
    got = jaccard.near_duplicates(make(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 5, 80)
    assert max(sizes) <= 10


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(make(spark, [])).count() == 0


def test_links_in_connects_as_all_links():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = []
    for i in range(60):
        s = base.copy()
        s[r.integers(0, 200, r.integers(0, 20))] = r.integers(0, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(s))
    m = jaccard.Measure(90, 3)
    links = jaccard.links_in(sets, m)
    assert len(links) < len(sets)
    for i, j in links:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert m.linked(both, len(sets[i]), len(sets[j]))


def brute_repeats(rows, length):
    seen = {}
    raw = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for (d, _), b in zip(rows, raw):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,seed", [(400, 32), (60, 16), (40, 39)])
def test_repeats(spark, length, seed):
    rows = corpus(length)
    got = repeats.remove_repeats(make(spark, rows), length=length, seed=seed).collect()
    assert sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in got), key=repr) == brute_repeats(rows, length)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(make(spark, [])).count() == 0


def test_repeats_of_hot_seeds(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    rows = corpus(5)
    got = repeats.remove_repeats(make(spark, rows), length=60, seed=16).collect()
    assert sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in got), key=repr) == brute_repeats(rows, 60)


def test_family_finds_all_matches_and_its_levels_fall_geometrically():
    r, length, seed = random.Random(0), 24, 8
    family, every = repeats.Family(length, seed), []
    for _ in range(40):
        batch = []
        for _ in range(r.randint(0, 30)):
            start = r.choice([b"anchored", b"anchors ", b"anchorag"])
            batch.append((start + bytes(r.choice(b"ab") for _ in range(r.randint(0, 16))), bytes(r.choice(b"ab") for _ in range(r.randint(0, 16)))))
        every += batch
        family.add(batch)
        sizes = [len(x) for x in family.levels]
        assert all(x > y for x, y in zip(sizes, sizes[1:]))
    family.whole()
    assert family.levels[0] == sorted((a, b, k) for k, (a, b) in enumerate(every))
    for i, (a, b) in enumerate(every):
        best = (0, 0)
        for j, (c, d) in enumerate(every):
            right, left = (len(os.path.commonprefix(x)) for x in ((a, c), (b, d)))
            if i != j and right >= seed and left + right >= length:
                best = max(best[0], left), max(best[1], right)
        assert (family.left[i], family.right[i]) == best


def test_bpe_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    parts = ["'s", "'re", "'", "  ", " ", "\n", "a", "B", "é", "1", "²", "Ⅷ", "_", "-", "ll", "'ll", "　", "\u0085", "\x1f", "漢", "🙂", "ve", "<|endoftext|>", "́"]
    rows = corpus(1) + [(1000 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(400)]
    for pattern in (public.PATTERN, r"\s|\S+"):
        coder = encoding if pattern == public.PATTERN else tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        coded = bpe.encode(make(spark, rows), path, pattern)
        got = bpe.decode(coded, path).collect()
        want = sorted(((d, np.array(coder.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows), key=repr)
        assert sorted(((x["doc_id"], bytes(x["token_ids"]), bytes(x["decoded"])) for x in got), key=repr) == want
        assert coded.columns == ["doc_id", "n", "component", "digest", "part", "token_ids"]
    none = bpe.decode(bpe.encode(make(spark, []), path, public.PATTERN), path)
    assert none.count() == 0 and none.columns[-2:] == ["token_ids", "decoded"]
    merges = bpe.Merges(open(path, "rb").read().splitlines())
    for word in (b"a" * 30_000, " ́e".encode() * 9000, bytes(r.randrange(256) for _ in range(5000)), b"", b"x"):
        long = merges.one(word)
        assert b"".join(merges.table[i] for i in long) == word
        assert merges.replay([word])[0] == np.array(long, "<u4").tobytes() if word else long == []


def test_bpe_round_trip_in_one_kernel(spark):
    """It gives what decode gives of encode, with null texts and ids and without rows."""
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    docs = make(spark, corpus(1))
    once = bpe.round_trip(docs, path, public.PATTERN)
    twice = bpe.decode(bpe.encode(docs, path, public.PATTERN), path)
    assert once.dtypes == twice.dtypes
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    assert bpe.round_trip(docs.limit(0), path, public.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.round_trip(docs, path, public.PATTERN, out_name="digest")


def brute_lines(rows, k=3):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = {}, []
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        gone = set()
        for p in range(len(lines) - k + 1):
            w = tuple(lines[p : p + k])
            if all(not x.strip(" ") for x in w):
                continue
            if seen.setdefault(w, (rows[i], p)) != (rows[i], p):
                gone |= {p, p + 1, p + 2}
        kept = rows[i][1] if not gone else "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((rows[i][0], kept, len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_line_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    monkeypatch.setattr(shared, "HOT_KEYS", 10_000)
    r = random.Random(8)
    lines = ["l%d" % i for i in range(12)] + ["", " "]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 14)))) for i in range(60)] + [(90, None), (91, ""), (92, "a\nb\nc\na\nb\nc\nd"), (93, "q\nq\nq\nq\nq\nq"), (94, "\n\n\n\n\n"), (95, "\n\n\n\n\n"), (96, "\n".join(f"line {i % 4000}" for i in range(9000)))]
    got = line_windows.dedup_lines(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, first string"))
    assert sorted(((x["doc_id"], x["text"], x["n_removed"]) for x in got.collect()), key=repr) == brute_lines(rows)
    assert got.columns == ["doc_id", "text", "first", "n_lines", "n_removed"]


def test_line_windows_with_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "a\nb\nc\nd"), (1, "x\na\nb\nc"), (1, "x\na\nb\nc"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, line_windows.dedup_lines(df).select("doc_id", "text", "n_removed").collect()), key=repr)
    assert got == sorted([(None, "a\nb\nc\nd", 0), (1, "x", 3), (1, "x", 3), (None, None, 0)], key=repr)
    assert line_windows.dedup_lines(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """One text of 300,000 words beside a copy with one word changed and a short one: as brute force says."""
    r = random.Random(12)
    long = [r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(5000)) for _ in range(300_000)]
    other = [*long[:1000], "changed", *long[1001:]]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, "alpha1 beta2")]
    got = {x["doc_id"]: x for x in jaccard.near_duplicates(make(spark, rows), "0.9", 3).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[3]["component_id"] == 3
    assert got[1]["n_shingles"] == len(set(zip(long, long[1:], long[2:])))
    left = {x["doc_id"]: x for x in repeats.remove_repeats(make(spark, rows)).collect()}
    # only what holds the changed word is there once: windows of 400 bytes on either side meet it
    assert left[1]["n_spans"] == left[2]["n_spans"] == 2 and left[3]["n_removed"] == 0
    assert all(0 < left[i]["n_bytes"] - left[i]["n_removed"] <= len(long[1000]) + len("changed") for i in (1, 2))


def test_digest_is_of_ids():
    assert hashlib.sha256(np.array([1], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\1\0\0\0").hexdigest()
