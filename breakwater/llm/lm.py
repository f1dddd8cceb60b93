"""Language-model scores by a weighted backoff automaton whose parts go where they are needed.

The model's states are the histories of up to `ORDER` - 1 words that the training
texts hold, and a root, the empty history. An n-gram that the training texts hold is an
arc from its history's state, labelled with its last word; it leads to the state of the
longest history that the n-gram ends with. Every state but the root has a failure arc to
the state of its history without the first word, which is taken for each word that has
no arc; the root has an arc for every word, known or not. Weights are smoothed by
Dirichlet priors, level by level: from state h an arc to w has
log10 P(w|h), P(w|h) = (c(hw) + m P(w|h')) / (c(h) + m), h' being h without its first
word and m the prior of that level (`PRIORS`); the failure arc has log10 m / (c(h) + m);
and the root's are p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). A text is one traversal from
left to right that carries the state and adds up the weights, from the end mark's
state to its own end mark.

The automaton has as many arcs as the corpus has different n-grams, so no task
and no broadcast holds it. Texts form blocks of about `BLOCK` bytes. For each level a
block's distinct n-grams are keys, dealt to shards by their range; a block sends its keys
and its training counts of them to the shards, none where it has no key, and a shard adds
up what all blocks sent and answers each. A block then builds the part of the automaton
that its texts walk through (`Automaton`), and they walk. Shards are as many as
keys of about `SHARD` each make, so that tasks do not grow with the corpus. Words'
keys have 64 bits; those of longer n-grams 20 bits more than the number of the
corpus's tokens takes, so that at any size one key in a million collides. Keys
are sent in sorted order as packed differences.

Null texts count as empty; an empty text is its end mark. Repeated rows are
scored, and learnt, each. Without training texts every probability is that of
the one unknown word, 1. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.llm.arrays import cut, mix, text_bytes, words
from breakwater.llm.shared import parts, saved

BLOCK, SHARD = 8 << 20, 1_500_000
ORDER = 3
#: Weight of the shorter history's probability at n-grams of two words, of three, and so on.
PRIORS = (1000.0, 10.0, 5.0, 5.0)
#: A long text is walked in pieces of so many tokens.
PIECE = 512
_END = np.uint64(0x2545F4914F6CDD1D)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes."""
    values = np.ascontiguousarray(values, "<u8")
    return zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstd.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def key_bits(tokens: int) -> int:
    """Bits of the keys of n-grams of two words and more."""
    return min(64, max(40, tokens.bit_length() + 20))


def _bounds(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Bounds of each shard's share of sorted keys."""
    inner = np.array([(i << bits) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)]))


class Grams:
    """A block's distinct n-grams, level by level.

    keys[k] are those of k + 1 words, sorted; place[k] tells for each token which of them ends there, -1 where the
    text has too few words before it (its first word follows the end mark, which nothing precedes).
    """

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int, bits: int):
        self.tokens, self.lengths = tokens, lengths
        self.firsts = np.cumsum(lengths) - lengths
        self.end = int(np.searchsorted(vocabulary, _END))
        at = np.arange(len(tokens)) - np.repeat(self.firsts, lengths)
        self.keys, self.place = [vocabulary], [tokens]
        word, last = vocabulary[tokens], vocabulary[tokens]
        for k in range(1, order):
            before = np.empty_like(last)
            before[1:] = last[:-1]
            if k == 1:
                before[self.firsts] = _END
            last = mix(before * _BASE + word + np.uint64(k))
            good = np.flatnonzero(at >= k - 1)
            distinct, inverse = np.unique(last[good] >> np.uint64(64 - bits), return_inverse=True)
            place = np.full(len(tokens), -1, np.int64)
            place[good] = inverse
            self.keys.append(distinct)
            self.place.append(place)

    def counts(self, learnt: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram ends at a token of the texts that are learnt."""
        weight = np.repeat(learnt, self.lengths)
        return [np.bincount(p[weight & (p >= 0)], minlength=len(k)) for k, p in zip(self.keys, self.place)]

    def examples(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(history, rest, word) of each n-gram of level k > 0: places of the n-gram without its last and its first word, and the last word."""
        some = np.flatnonzero(self.place[k] >= 0)
        token = np.empty(len(self.keys[k]), np.int64)
        token[self.place[k][some]] = some
        history = self.place[k - 1][token - 1]
        if k == 1:
            first = np.zeros(len(self.tokens), bool)
            first[self.firsts] = True
            history = np.where(first[token], self.end, history)
        return history, self.place[k - 1][token], self.tokens[token]


class Automaton:
    """The part of the backoff automaton that a block's texts walk through.

    State 0 is the root; then come the words, then the n-grams of two words, up to one word fewer than the order.
    Arcs are sorted by state and word.
    """

    def __init__(self, grams: Grams, counts: Sequence[np.ndarray], n: int, v: int, priors: Sequence[float]):
        order, self.words = len(grams.keys), len(grams.keys[0])
        base = 1 + np.cumsum([0, *(len(k) for k in grams.keys[: order - 1])])
        self.fail_to = np.zeros(base[-1], np.int64)
        self.fail_weight = np.zeros(base[-1])
        p = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
        every = np.arange(self.words)
        self.root = p
        # a level's states follow those of the level before, so arcs are sorted level by level
        arcs, weights = [every], [np.log10(p)]
        targets = [np.where(counts[0] > 0, 1 + every, 0) if order > 1 else np.zeros(self.words, np.int64)]
        for k in range(1, order):
            history, rest, word = grams.examples(k)
            m, have = priors[k - 1], counts[k - 1]
            self.fail_weight[base[k - 1] : base[k]] = np.log10(m / (have + m))
            if k < order - 1:
                self.fail_to[base[k] : base[k + 1]] = base[k - 1] + rest
            p = np.where(counts[k] > 0, (counts[k] + m * p[rest]) / (have[history] + m), 0.0)
            seen = np.flatnonzero(counts[k] > 0)
            arc = (base[k - 1] + history[seen]) * self.words + word[seen]
            by = np.argsort(arc)
            seen = seen[by]
            arcs.append(arc[by])
            weights.append(np.log10(p[seen]))
            targets.append(base[k] + seen if k < order - 1 else base[k - 1] + rest[seen])
            del history, rest, word, arc, by, seen
        self.arcs = np.concatenate((*arcs, [np.int64(1) << 62]))
        self.weights, self.targets = np.concatenate(weights), np.concatenate(targets)
        self.start = 1 + grams.end if order > 1 and counts[0][grams.end] > 0 else 0
        self.memory = order - 1

    def walk(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 probability of each text, all texts walking side by side.

        A long text walks in pieces. A piece begins `memory` tokens early, at the root and without adding weights: a
        state is told by so many words, so the piece then is in the state in which the piece before it ends.
        """
        pieces = -(-lengths // PIECE)
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(lengths) - lengths)[text] + nth * PIECE
        size = np.minimum(lengths[text] - nth * PIECE, PIECE)
        early = np.where(nth > 0, self.memory, 0)
        begin, size = begin - early, size + early
        by = np.argsort(-size, kind="stable")
        text, begin, size, early = text[by], begin[by], size[by], early[by]
        state = np.where(early > 0, 0, self.start)
        if not self.memory:
            state[:] = 0
        total = np.zeros(len(text))
        for step in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -step))  # pieces that have a token left
            word, now, add = tokens[begin[:n] + step], state[:n].copy(), np.zeros(n)
            todo = np.arange(n)
            while len(todo):
                key = now[todo] * self.words + word[todo]
                at = np.searchsorted(self.arcs, key)
                found = self.arcs[at] == key
                there, arc = todo[found], at[found]
                add[there] += self.weights[arc]
                state[there] = self.targets[arc]
                todo = todo[~found]
                add[todo] += self.fail_weight[now[todo]]
                now[todo] = self.fail_to[now[todo]]
            total[:n] += np.where(step >= early[:n], add, 0)
        return np.bincount(text, total, len(lengths))


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, n_tokens, ids, train, lengths, vocabulary, tokens) of (doc_id, train, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            size = -(-len(data) // max(1, -(-len(data) // BLOCK)))
            for row, to, data, bounds in cut(data, bounds, max(size, 1)):
                n, hashes, rows = to - row, [], []
                for low, high, some, ends in cut(data, bounds, 1 << 20):
                    at, _, _, h = words(some, ends)
                    rows += [at + low, np.arange(low, high)]
                    hashes += [h, np.full(high - low, _END)]
                rows, hashes = np.concatenate(rows), np.concatenate(hashes)
                order = np.argsort(rows, kind="stable")  # an end mark comes after its text's words
                vocabulary, tokens = np.unique(hashes[order], return_inverse=True)
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0).slice(row, n))
                train = pa.array([np.packbits(batch.column(1).slice(row, n).to_numpy(zero_copy_only=False).astype(bool)).tobytes()], pa.binary())
                packed = [pa.array([x], pa.binary()) for x in (pack(np.bincount(rows, minlength=n)), pack_sorted(vocabulary), pack(tokens))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(tokens)]), ids, train, *packed], ["block", "n_tokens", "ids", "train", "lengths", "vocabulary", "tokens"])
                block += 1

    return docs.mapInArrow(run, f"block long, n_tokens long, ids array<{kind}>, train binary, lengths binary, vocabulary binary, tokens binary")


_PACKED = ["train", "lengths", "vocabulary", "tokens"]


def _opened(train: bytes, lengths: bytes, vocabulary: bytes, tokens: bytes, order: int, bits: int) -> tuple[np.ndarray, Grams]:
    n = unpack(lengths).astype(np.int64)
    learnt = np.unpackbits(np.frombuffer(train, np.uint8), count=len(n)).astype(bool)
    return learnt, Grams(unpack_sorted(vocabulary), unpack(tokens).astype(np.int64), n, order, bits)


def _lists(columns: list[list[bytes]]) -> pa.Array:
    """A list column of the given columns' values."""
    rows = len(columns[0])
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(columns), pa.int32()), pa.array([x for row in zip(*columns) for x in row], pa.binary()))


def _requests(blocks: DataFrame, shards: int, order: int, bits: int) -> DataFrame:
    """(shard, block, keys, counts): keys that a block needs, by level, and its training counts of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                learnt, grams = _opened(*(batch.column(c)[row].as_py() for c in _PACKED), order, bits)
                ends = [_bounds(keys, bits if k else 64, shards) for k, keys in enumerate(grams.keys)]
                some = np.flatnonzero(sum(np.diff(e) for e in ends)).tolist()
                keys = [[pack_sorted(x[e[i] : e[i + 1]]) for i in some] for x, e in zip(grams.keys, ends)]
                counts = [[pack(x[e[i] : e[i + 1]]) for i in some] for x, e in zip(grams.counts(learnt), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), batch.column("block")[row].as_py())), _lists(keys), _lists(counts)], ["shard", "block", "keys", "counts"])

    return blocks.select("block", *_PACKED).mapInArrow(run, "shard long, block long, keys array<binary>, counts array<binary>")


def _answers(requests: DataFrame, shards: int, order: int) -> DataFrame:
    """(block, shard, counts, n, v): the counts asked for, and the shard's training tokens and distinct words."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts, out, n, v = table["keys"].to_pylist(), table["counts"].to_pylist(), [], 0, 0
        for k in range(order):
            asked = [unpack_sorted(x[k]) for x in keys]
            every, place = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(place, np.concatenate([unpack(x[k]) for x in counts]).astype(float), len(every)).astype(np.uint64)
            if not k:
                n, v = int(total.sum()), int((total > 0).sum())
            ends = np.cumsum([len(a) for a in asked])[:-1]
            out.append([pack(total[p]) for p in np.split(place, ends)])
        rows = table.num_rows
        return pa.table([table["block"], table["shard"], _lists(out), pa.array(np.full(rows, n)), pa.array(np.full(rows, v))], ["block", "shard", "counts", "n", "v"])

    return requests.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "block long, shard long, counts array<binary>, n long, v long")


def score(docs: DataFrame, train: Column, text: str = "text", id_: str = "doc_id", order: int = ORDER, priors: Sequence[float] = PRIORS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; texts where `train` is true are learnt."""
    if order < 1 or len(priors) < order - 1 or min(priors, default=1) <= 0:
        raise ValueError("an order of 1 or more and a positive prior for each level above the first are needed")
    spark = docs.sparkSession
    named = docs.select(F.col(id_).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(text, F.lit("")).alias("text"))
    kind = dict(named.dtypes)["doc_id"]
    blocks = saved(_blocks(named))
    tokens, count = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    bits, shards = key_bits(tokens), max(parts(spark), math.ceil(tokens * order / SHARD))
    answers = saved(_answers(_requests(blocks, shards, order, bits), shards, order))
    n, v = answers.groupBy("shard").agg(F.first("n").alias("n"), F.first("v").alias("v")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        row = {c: block[c][0] for c in block.column_names}
        _, grams = _opened(*(row[c].as_py() for c in _PACKED), order, bits)
        every = got.sort_by("shard")["counts"].to_pylist()
        counts = [np.concatenate([unpack(x[k]) for x in every]).astype(np.int64) for k in range(order)]
        automaton = Automaton(grams, counts, n, v, priors)
        add = lambda x: np.add.reduceat(x, grams.firsts)
        known = add((counts[0][grams.tokens] > 0).astype(np.int64))
        base = add(np.log10(automaton.root)[grams.tokens])
        return pa.table([row["ids"].values, pa.array(grams.lengths), pa.array(known), pa.array(np.full(len(known), n)), pa.array(base), pa.array(automaton.walk(grams.tokens, grams.lengths))], names)

    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    to = max(parts(spark), count)
    sides = (x.repartition(to, "block").groupBy("block") for x in (blocks, answers))
    return next(sides).cogroup(next(sides)).applyInArrow(run, schema)
