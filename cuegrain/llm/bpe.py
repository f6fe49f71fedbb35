"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are whole
vocabulary entries. Tier two: the others are merged by a heap of ranked pairs over a linked
list of their bytes, O(n log n) however long the pre-token is.

Defined cases: null and empty texts give no ids; white space only, control characters and any
Unicode text are encoded as they stand (no special tokens, no normalisation); repeated rows are
encoded each; other columns of the input are kept unless they bear an output's name, which the
output then takes; an empty table gives an empty table. A text is encoded whole: memory grows
with the longest single text, never with the table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, mapped, pieces, ship, without
from .hashing import Rolling, mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, about n/3 displacements.

    Keys fall in buckets; the fullest bucket first, each takes the first seed that sends all its
    keys to free slots. A bucket of one key stores its slot itself, as a negative number.
    """

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n, self.m = n, max(1, n // 3)
        self.displace = np.zeros(self.m, dtype=np.int64)
        self.owner = np.full(n, -1, dtype=np.int64)
        bucket = (hashes % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.m)
        first = np.concatenate(([0], np.cumsum(sizes)))
        free = np.ones(n, dtype=bool)
        seeds = np.arange(1, 257, dtype=np.uint64)[:, None]
        for b in np.argsort(-sizes, kind="stable"):
            keys = order[first[b] : first[b + 1]]
            if len(keys) < 2:
                break
            base, tried = hashes[keys][None, :], np.uint64(0)
            while True:
                slots = self._slots(base, seeds + tried)
                good = free[slots].all(axis=1)
                for row in np.flatnonzero(good):
                    if len(set(slots[row].tolist())) == len(keys):
                        break
                else:
                    tried += np.uint64(len(seeds))
                    continue
                self.displace[b] = int(seeds[row, 0] + tried)
                self.owner[slots[row]] = keys
                free[slots[row]] = False
                break
        left = np.flatnonzero(free)
        single = np.flatnonzero(sizes == 1)
        self.displace[single] = -left[: len(single)] - 1
        self.owner[left[: len(single)]] = order[first[single]]

    def _slots(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (mix(hashes + seeds * _STEP) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The key number in each hash's slot; whether it is that key is for the caller to compare."""
        d = self.displace[(hashes % np.uint64(self.m)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._slots(hashes, d.astype(np.uint64)))
        return self.owner[slot]


def _hash_all(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    return Rolling(np.frombuffer(b"".join(keys), dtype=np.uint8)).ranges(starts, ends)


class Vocabulary:
    """Ranks, the perfect hash over their byte strings, and the table for decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = list(ranks)
        self.ids = np.array([ranks[t] for t in self.tokens], dtype=np.int32)
        self.pattern = pattern
        self.hash = PerfectHash(_hash_all(self.tokens))
        size = int(self.ids.max()) + 1
        self.length = np.zeros(size, dtype=np.int64)
        self.length[self.ids] = [len(t) for t in self.tokens]
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        by_id = [b""] * size
        for t, i in zip(self.tokens, self.ids.tolist(), strict=True):
            by_id[i] = t
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)


class Coder:
    """Encodes and decodes in one worker; keeps the ids of pre-tokens seen, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 300_000):
        self.v, self.keep = vocabulary, keep
        self.ranks = dict(zip(vocabulary.tokens, vocabulary.ids.tolist(), strict=True))
        self.find = regex.compile(vocabulary.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ids = vocabulary.ids.tolist()
        self.pairs = [[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.forget()

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first, by a heap; links skip the bytes that merges took."""
        n, rank, pairs = len(piece), self.ranks.get, self.pairs
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))
        best = [pairs[a][b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of this part with the next, or -1
        best.append(-1)
        heap = [r << 40 | i for i, r in enumerate(best) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFFFF
            if best[i] != top >> 40:
                continue  # one of the two parts has been merged since
            middle = end[i]
            stop = end[i] = end[middle]
            best[middle] = best[i] = -1
            if stop < n:
                before[stop] = i
                best[i] = r = rank(piece[i : end[stop]], -1)
                if r >= 0:
                    push(heap, r << 40 | i)
            j = before[i]
            if j >= 0:
                best[j] = r = rank(piece[j:stop], -1)
                if r >= 0:
                    push(heap, r << 40 | j)
        out, i = [], 0
        while i < n:
            stop = end[i]
            out.append(rank(piece[i:stop]))
            i = stop
        return out

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.int32)
        self.sizes = self.starts = np.empty(0, dtype=np.int64)

    def learn(self, fresh: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in fresh]
        slots = self.v.hash.lookup(_hash_all(raw)).tolist()
        tokens, ids = self.v.tokens, self.ids
        rows = [[ids[slot]] if tokens[slot] == piece else self.merge(piece) for piece, slot in zip(raw, slots, strict=True)]
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(rows), dtype=np.int32)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offset at which each text's begin."""
        found = [self.find(t) if t else [] for t in texts]
        if len(self.known) > self.keep:
            self.forget()
        if fresh := list(set().union(*found).difference(self.known)):
            self.learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), dtype=np.int64)
        sizes = self.sizes[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        texts_end = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
        return self.flat[_spread(self.starts[at], sizes)], ends[texts_end]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the offset at which each row's begin."""
        sizes = self.v.length[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.v.bytes[_spread(self.v.start[ids], sizes)], ends[offsets]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. for sizes[0] values, then the same for each next start."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total, dtype=np.int64)


_coders: dict[str, Coder] = {}


def _coder(shared) -> Coder:
    key = str(shared.id if hasattr(shared, "id") else id(shared))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(shared.value)
    return _coders[key]


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`df` with the ids of each whole text as ARRAY<INT>, and with `decoded`, what decoding those ids gives as BINARY.

    The vocabulary is broadcast: its size is fixed by its file, whatever the table's.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    keep = without(df, ids, *([decoded] if decoded else []))
    made = [(ids, T.ArrayType(T.IntegerType()))] + ([(decoded, T.BinaryType())] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            texts = batch.column(1)
            for a, b in pieces(texts):
                found, offsets = coder.encode(texts.slice(a, b - a).to_pylist())
                out = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found, type=pa.int32()))]
                if decoded:
                    raw, at = coder.decode(found, offsets)
                    out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], names=["_row", *[f for f, _ in made]])

    return mapped(df, keep, col(text), run, made)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the bytes of each row's ids; null ids give no bytes. The ids must be the vocabulary's."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    keep = without(df, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            column = batch.column(1)
            offsets = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            raw, at = coder.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["_row", decoded])

    return mapped(df, keep, F.coalesce(col(ids), F.array().cast("array<int>")), run, [(decoded, T.BinaryType())])


def digests(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document the number of its ids and SHA-256 of the decimal ids and of the decoded bytes."""
    coded = encode(df.select("doc_id", "text"), vocabulary, decoded="decoded").drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
