"""Byte-level BPE encoding and decoding by replaying the merges over a block's distinct words.

The words (matches of the split pattern) of a block of documents are gathered
once each into flat arrays. An inverted index leads from the rank of a token
pair to the positions where the pair stands; ranks are taken in rising order,
every position of a rank is merged at once, and only the two neighbours of a
merge enter the index anew. Documents are then written as the joined ids of
their words. A block is what one Arrow batch brings, so memory is bounded and
no vocabulary of the corpus has to be in one place.

Nulls count as empty texts; empty texts have no ids; extra columns pass through.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from breakwater.llm.arrays import PIECE, cut, pieces, prefix_hashes, releasing, span_hashes

#: Documents are taken in blocks of so many bytes.
BLOCK = 2 << 20
_END = 1 << 16


class Merges:
    """Ranks of a byte-level vocabulary and every pair of its tokens that joins to a token."""

    def __init__(self, lines: Iterable[bytes]):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        if len(self.ranks) > _END or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a rank file needs all 256 single bytes and at most 65,536 tokens")
        keys, ranks = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 17 | b)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(1) << 62)
        self.values = np.append(np.array(ranks, np.int32)[order], np.int32(-1))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.table = {r: t for t, r in self.ranks.items()}

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b join to, else -1."""
        key = a.astype(np.int64) << 17 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], np.int32(-1))

    def one(self, word: bytes) -> list[int]:
        """Ids of a single word: the lowest rank first, leftmost among equals, by a heap of pairs over a linked list."""
        n = len(word)
        tokens: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: self.ranks.get(tokens[i] + tokens[j]) if i >= 0 and j < n else None
        heap = [(r, i) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if tokens[i] is None or (j := after[i]) >= n or rank(i, j) != r:
                continue  # one of the two has been merged since
            tokens[i], tokens[j], after[i] = tokens[i] + tokens[j], None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(i, after[i])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank(before[i], i)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [self.ranks[t] for t in tokens if t is not None]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths + 1)  # each word is followed by an end mark
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        tok = self.single[raw]
        tok[ends - 1] = _END
        n = len(tok)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[-1] = n - 1
        prv[0] = n - 1
        alive = np.ones(n, bool)
        now = self.pair(tok, tok[nxt])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            order = order[np.searchsorted(ranks[order], 0) :]
            if not len(order):
                return
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, some in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(some)
                else:
                    index[r] = [some]
                    heapq.heappush(heap, r)

        enter(np.arange(n), now)
        again: list[np.ndarray] = []
        while heap:
            rank = heapq.heappop(heap)
            at = index.pop(rank)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[now[at] == rank]
            if not len(at):
                continue
            if len(at) > 1 and (follow := nxt[at[:-1]] == at[1:]).any():
                # in a run of overlapping pairs every second one is merged
                first = np.concatenate(([True], ~follow))
                begun = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begun) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = rank
            nxt[at] = after
            prv[after] = at
            alive[gone] = False
            now[gone] = -1
            left = prv[at]
            right_rank, left_rank = self.pair(tok[at], tok[after]), self.pair(tok[left], tok[at])
            now[at] = right_rank
            now[left] = left_rank
            both, ranks = np.concatenate((at, left)), np.concatenate((right_rank, left_rank))
            if (early := (ranks >= 0) & (ranks <= rank)).any():
                again.append(both[early])  # a new pair that would have come first: such words are done singly
            enter(both, ranks)
        alive[ends - 1] = False
        counts = np.add.reduceat(alive, np.concatenate(([0], ends[:-1])))
        ids = tok[alive].astype("<u4").tobytes()
        to = np.cumsum(counts) * 4
        out = [ids[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist())]
        for w in np.unique(np.searchsorted(ends, np.concatenate(again), "right")).tolist() if again else ():
            out[w] = np.array(self.one(words[w]), "<u4").tobytes()
        for w, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[w] = whole.to_bytes(4, "little")
        return out


def _lines(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return f.read().splitlines()


def _table(lines: list[bytes]) -> dict[int, bytes]:
    return {int(r): base64.b64decode(t) for t, r in (x.split() for x in lines if x.strip())}


#: The split pattern that `Splitter` follows; any other is run by the regex library.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 0


def classes() -> bytes:
    """For each code point whether it is a letter, a number, white space or another character (compressed)."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, what in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(what, every):
            a, b = m.span()
            out[ord(every[a]) : ord(every[b - 1]) + 1] = kind
    out[0xD800:0xE000] = _OTHER
    return zlib.compress(out.tobytes())


class Splitter:
    """Starts of the known pattern's matches in a piece of text, found by runs of character classes."""

    def __init__(self, packed: bytes):
        self.kind = np.frombuffer(zlib.decompress(packed), np.uint8)

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte positions at which matches start, over all texts; matches cover every byte."""
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64)
        byte = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF).astype(np.int8) + (cp > 0xFFFF), out=byte[1:])
        head = np.zeros(n + 1, bool)  # characters that begin a text; n as well
        head[np.searchsorted(byte, bounds)] = True
        kind = self.kind[cp]
        run = head[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(run)
        to = np.append(at[1:], n)
        what = kind[at]
        begins = np.zeros(n + 1, bool)
        # runs of letters, numbers and others take one space before them
        solid = at[what != _BLANK]
        spaced = (solid > 0) & ~head[solid] & (cp[solid - 1] == 32)
        begins[solid - spaced] = True
        # white space: all but its last character is one match, unless the text ends with it
        a, b = at[what == _BLANK], to[what == _BLANK]
        ends = head[b]
        begins[a[ends | (b - a > 1)]] = True
        lone = b[~ends] - 1
        begins[lone[cp[lone] != 32]] = True
        # contractions: an apostrophe alone in its run, with no space taken, before certain letters
        p = at[(what == _OTHER) & (to - at == 1) & (cp[at] == 39) & ~head[to]]
        p = p[(p == 0) | head[p] | (cp[p - 1] != 32)]
        if len(p):
            one = cp[p + 1]
            two = np.where(head[np.minimum(p + 2, n)], 0, cp[np.minimum(p + 2, n - 1)])
            long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            taken = long | np.isin(one, [115, 116, 109, 100])
            p, size = p[taken], np.where(long, 2, 1)[taken]
            begins[p + 1] = False
            e = p + 1 + size
            letter = (e < n) & ~head[e]
            letter &= kind[np.minimum(e, n - 1)] == _LETTER
            begins[e[letter]] = True
        return byte[:-1][begins[:n]]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`docs` with the texts' ids as binary (little-endian unsigned 32-bit integers) in a new last column.

    `ranks` is a rank file (token in base64, rank) that the driver reads; it
    holds at most 65,536 tokens and is broadcast. `pattern` splits the text.
    The text column itself is left out of the result.
    """
    run, schema = _encoding(docs, ranks, pattern, text, ids)
    return docs.select(*schema.names[:-1], text).mapInArrow(releasing(run), schema)


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "token_ids", out_name: str = "decoded") -> DataFrame:
    """`decode` of `encode`, block by block in one kernel: half the workers, and ids don't go back and forth between them."""
    run, schema = _encoding(docs, ranks, pattern, text, ids)
    names = schema.names
    if out_name in names:
        raise ValueError(f"a column {out_name} exists; name another one")
    shared = docs.sparkSession.sparkContext.broadcast(_lines(ranks))
    both = lambda batches: _decoded(shared.value, run(batches), names, len(names) - 1, out_name)
    return docs.select(*names[:-1], text).mapInArrow(releasing(both), T.StructType([*schema.fields, T.StructField(out_name, T.BinaryType())]))


def _encoding(docs: DataFrame, ranks: str, pattern: str, text: str, ids: str) -> tuple[Callable, T.StructType]:
    """The kernel of `encode` over all other columns and the text, and the schema of its result."""
    lines = _lines(ranks)
    if len(lines) > _END:
        raise ValueError("a rank file has at most 65,536 tokens")
    shared = docs.sparkSession.sparkContext.broadcast((lines, classes() if pattern == KNOWN else None))
    names = [c for c in docs.columns if c != text]
    if ids in names:
        raise ValueError(f"a column {ids} exists; name another one")
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, packed = shared.value
        merges, block = Merges(lines), Block(Splitter(packed) if packed else regex.compile(pattern))
        for batch in batches:
            column = batch.column(len(names))
            for row, to, data, bounds in pieces(column, BLOCK):
                out = block.encode(merges, data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(row, to - row) for i in range(len(names))] + [out], [*names, ids])

    return run, T.StructType([*kept, T.StructField(ids, T.BinaryType())])


class Block:
    """Encodes a block of texts: each distinct word once, then every text as its words' ids."""

    def __init__(self, split: Splitter | regex.Pattern):
        self.split = split

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if isinstance(self.split, Splitter):
            return self.split.starts(data, bounds)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            text, at, size = data[a:b].tobytes().decode(), 0, a
            for m in self.split.finditer(text):
                if m.start() != at:
                    raise ValueError("the pattern has to match every character")
                out.append(size)
                at = m.end()
                size += len(m[0].encode())
        return np.array(out, np.int64)

    def encode(self, merges: Merges, data: np.ndarray, bounds: np.ndarray) -> pa.Array:
        raws, spans, hashes, first = [], [], [], []
        sizes = np.zeros(len(bounds) - 1, np.int64)
        for row, to, part, cuts in cut(data, bounds, PIECE):
            starts = self.starts(part, cuts)
            ends = np.append(starts[1:], len(part)) if len(starts) else starts
            h = span_hashes(prefix_hashes(part), starts, ends)
            distinct, at = np.unique(h, return_index=True)
            spans.append(np.stack((np.full(len(at), len(raws)), starts[at], ends[at]), axis=1))
            raws.append(part.tobytes())
            first.append(distinct)
            hashes.append(h)
            sizes[row:to] = np.diff(np.searchsorted(starts, cuts))
        distinct, at = np.unique(np.concatenate(first), return_index=True)
        coded = merges.replay([raws[k][a:b] for k, a, b in np.concatenate(spans)[at].tolist()])
        count = np.array([len(c) for c in coded], np.int64) // 4
        begin = np.concatenate(([0], np.cumsum(count)))
        every = np.frombuffer(b"".join(coded), "<u4")
        out, ends, base = [], [np.zeros(1, np.int64)], 0
        for h in hashes:
            w = np.searchsorted(distinct, h)
            n = count[w]
            to = np.cumsum(n)
            total = int(to[-1]) if len(to) else 0
            out.append(every[np.repeat(begin[w] - (to - n), n) + np.arange(total)])
            ends.append(to + base)
            base += total
        ids = np.concatenate(out)
        ends = np.concatenate(ends)[np.concatenate(([0], np.cumsum(sizes)))] * 4
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])


def decode(encoded: DataFrame, ranks: str, ids: str = "token_ids", out_name: str = "decoded") -> DataFrame:
    """`encoded` with the bytes that the ids stand for in a new last column (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(_lines(ranks))
    names = encoded.columns
    if out_name in names:
        raise ValueError(f"a column {out_name} exists; name another one")
    at = names.index(ids)

    run = lambda batches: _decoded(shared.value, batches, names, at, out_name)
    return encoded.mapInArrow(releasing(run), T.StructType([*encoded.schema.fields, T.StructField(out_name, T.BinaryType())]))


def _decoded(lines: list[bytes], batches: Iterator[pa.RecordBatch], names: list[str], at: int, out_name: str) -> Iterator[pa.RecordBatch]:
    """The batches with the bytes of the ids in column `at` as a new last column."""
    table = _table(lines)
    size = np.zeros(max(table, default=0) + 1, np.int64)
    for r, t in table.items():
        size[r] = len(t)
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(table.get(r, b"") for r in range(len(size))), np.uint8)
    del table
    for batch in batches:
        column = batch.column(at)
        column = column.fill_null(b"") if column.null_count else column
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        for row, to, part, cuts in cut(raw, ends - ends[0], PIECE):
            tokens = part.view("<u4")
            n = size[tokens]
            to_ = np.cumsum(n)
            out = flat[np.repeat(begin[tokens] - (to_ - n), n) + np.arange(int(to_[-1]) if len(to_) else 0)]
            edges = np.concatenate(([0], to_))[cuts // 4].astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), to - row, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.slice(row, to - row).columns, texts], [*names, out_name])
