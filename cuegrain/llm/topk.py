"""Exact top-k inner products by a bit-sliced index.

Candidates are cut into blocks of about BLOCK rows by a hash of their id. A block's index holds,
for each component, its BITS leading bits over the block's range as bitmaps over the rows (bit
slices), and the whole values beside them. For a query the slices are weighted by the query's
binary digits and summed by carry-save bitmap adders, negative weights on complemented slices;
that gives every row's quantised score as slices again. The k-th largest is found from the most
significant slice downward; rows whose score could still reach it once the bits left out are
added back, the boundary, are selected by a second walk from the top and resolved exactly.

Queries come in packs of QUERIES_A_PACK, in as few bytes as the values need. A block meets its packs
in groups of PACKS_A_GROUP, so the index is shuffled once for some 65,000 queries and a group has a
bounded size. A block gives at most k rows a query, and Spark ranks those. Nothing grows with rows
times queries but the bitmap work.

Defined cases: vectors that are null or empty, or hold a null or non-finite component, take no part as
query or candidate, nor do those with a null id; only vectors of the query's length compare; rows
that share the query's id are its own and are left out; repeated rows are candidates each; rows
that share a query id and vector are one query, those that share only the id are queries each;
ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none.
Scores must fit 64 bits.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged

BLOCK, BITS, QUERIES_A_PACK, PACKS_A_GROUP = 8192, 8, 2048, 32
MOST_TASKS = 20_000


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null if a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) > 0) & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Slices:
    """The index of one block: ids, how often each row is there, whole values (rows x components) and bit slices of the leading bits."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, times: np.ndarray | None = None):
        self.ids, self.values = ids, values
        self.times = np.ones(len(ids), dtype=np.int64) if times is None else times
        n, d = values.shape
        self.low = values.min(axis=0)
        above = values - self.low
        self.shift = max(0, int(above.max(initial=0)).bit_length() - BITS)
        lead = np.zeros((-(-n // 64) * 64, d), dtype=np.uint8)
        lead[:n] = above >> self.shift
        lead = np.ascontiguousarray(lead.T)
        words = [np.packbits(lead >> b & 1, axis=1, bitorder="little").view(np.uint64) for b in range(BITS)]
        self.slices = np.stack(words, axis=1)  # component, bit, words
        rows = np.zeros(lead.shape[1], dtype=np.uint8)
        rows[:n] = 1
        self.rows = np.packbits(rows, bitorder="little").view(np.uint64)

    def weighted(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum of |q| times the leading bits, complemented where q is negative."""
        size = np.abs(query)
        digits = int(size.max(initial=0)).bit_length()
        flip = np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
        waiting: list[list[np.ndarray]] = [[] for _ in range(digits + BITS)]
        for i in range(digits):
            chosen = np.flatnonzero(size >> i & 1)
            for b in range(BITS):
                waiting[i + b].append(self.slices[chosen, b] ^ flip[chosen])
        out, j = [], 0
        while j < len(waiting):
            maps = np.concatenate(waiting[j]) if waiting[j] else np.empty((0, len(self.rows)), dtype=np.uint64)
            if len(maps) > 1 and j + 1 == len(waiting):
                waiting.append([])
            while len(maps) > 1:
                m = len(maps) // 3 * 3
                if m:
                    a, b, c = maps[0:m:3], maps[1:m:3], maps[2:m:3]
                    odd = a ^ b
                    waiting[j + 1].append((a & b) | (c & odd))
                    maps = np.concatenate((odd ^ c, maps[m:]))
                else:
                    waiting[j + 1].append((maps[:1] & maps[1:2]))
                    maps = maps[:1] ^ maps[1:2]
            out.append((maps[0] if len(maps) else np.zeros_like(self.rows)) & self.rows)
            j += 1
        return out

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k largest."""
        if len(self.ids) <= k:
            return np.arange(len(self.ids))
        sums = self.weighted(query)
        count = lambda x: int(np.bitwise_count(x).sum())
        sure, open_, kth = np.zeros_like(self.rows), self.rows.copy(), 0
        for j in range(len(sums) - 1, -1, -1):
            high = open_ & sums[j]
            if count(sure) + count(high) >= k:
                open_ = high
                kth |= 1 << j
            else:
                sure |= high
                open_ &= ~sums[j]
        # bits left out add less than the sum of |q| to one row and nothing to another
        least = kth - (int(np.abs(query).sum()) if self.shift else 0)
        if least <= 0:
            return np.arange(len(self.ids))
        above, equal = np.zeros_like(self.rows), self.rows.copy()
        if least >> len(sums):
            return np.empty(0, dtype=np.int64)
        for j in range(len(sums) - 1, -1, -1):
            if least >> j & 1:
                equal &= sums[j]
            else:
                above |= equal & sums[j]
                equal &= ~sums[j]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best different rows: ids, scores, how often each is there."""
        rows = self.boundary(query, k + 1)  # one more: the query's own row may be among them
        rows = rows[self.ids[rows] != query_id]
        scores = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best], self.times[rows][best]

    def pack(self) -> dict[str, bytes]:
        return {"ids": self.ids.tobytes(), "times": narrow(self.times), "values": narrow(self.values), "slices": self.slices.tobytes(), "head": np.array([self.shift, *self.low], dtype=np.int64).tobytes()}

    @classmethod
    def unpack(cls, dim: int, ids: bytes, times: bytes, values: bytes, slices: bytes, head: bytes) -> Slices:
        self = cls.__new__(cls)
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.times = widen(times, len(self.ids))
        self.values = widen(values, len(self.ids) * dim).reshape(-1, dim)
        self.slices = np.frombuffer(slices, dtype=np.uint64).reshape(dim, BITS, -1)
        numbers = np.frombuffer(head, dtype=np.int64)
        self.shift, self.low = int(numbers[0]), numbers[1:]
        rows = np.zeros(self.slices.shape[2] * 64, dtype=np.uint8)
        rows[: len(self.ids)] = 1
        self.rows = np.packbits(rows, bitorder="little").view(np.uint64)
        return self


def narrow(values: np.ndarray) -> bytes:
    """The values in the fewest bytes each that hold all of them."""
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)).tobytes()


def widen(raw: bytes, n: int) -> np.ndarray:
    """The `n` values that narrow() packed."""
    return np.frombuffer(raw, dtype=f"i{len(raw) // n}" if n else np.int64).astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def build(vectors: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """One row for each block: dim, block and its packed index. `vectors` has vec_id and integer v."""
    ship(vectors.sparkSession)
    blocks = max(1, -(-vectors.count() // block))

    def index(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
        made = Slices(table["vec_id"].to_numpy()[order].astype(np.int64), _matrix(table)[order], table["times"].to_numpy()[order]).pack()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in made.items()})

    # repeats of a row are one row with their number, so that no block is filled by them
    counted = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    keyed = counted.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    return keyed.groupBy("dim", "block").applyInArrow(index, "dim int, block int, ids binary, times binary, values binary, slices binary, head binary"), blocks


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best of `vectors` for each distinct row of `queries` (both vec_id and v, of integers)."""
    index, blocks = build(vectors)
    index = staged(index, "bit-slices")
    asked = staged(queries.distinct().withColumn("dim", F.size("v")), "bit-slice-queries")
    n = asked.count()
    # small tables are cut finer, so that there are some tens of tasks; a pack never exceeds its bound
    packs = max(1, -(-n // QUERIES_A_PACK), min(-(-n // 32), -(-48 // blocks)))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        row = {"dim": pa.array([key[0].as_py()], pa.int32()), "pack": pa.array([key[1].as_py()], pa.int32())}
        made = (table["vec_id"].to_numpy().astype(np.int64).tobytes(), narrow(_matrix(table)))
        return pa.table(row | {k: pa.array([v], pa.binary()) for k, v in zip(("queries", "asked"), made, strict=True)})

    keyed = asked.withColumn("pack", F.pmod(F.xxhash64("vec_id", "v"), F.lit(packs)).cast("int"))
    packed = staged(keyed.groupBy("dim", "pack").applyInArrow(pack, "dim int, pack int, queries binary, asked binary"), "bit-slice-packs")
    # a group is a block with some of its packs; where blocks are few there are more groups of fewer packs
    copies = max(-(-packs // PACKS_A_GROUP), min(packs, -(-48 // blocks)))
    tasks = min(blocks * copies, MOST_TASKS)
    left = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod("pack", F.lit(copies)))
    right = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    keys = ["dim", "block", "part"]
    work = left.repartition(tasks, *keys).hint("merge").join(right.repartition(tasks, *keys), keys)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        block = Slices.unpack(dim, *(table[c][0].as_py() for c in ("ids", "times", "values", "slices", "head")))
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for queries, asked in zip(table["queries"], table["asked"], strict=True):
            ids = np.frombuffer(queries.as_py(), dtype=np.int64)
            for q, v in zip(ids.tolist(), widen(asked.as_py(), len(ids) * dim).reshape(-1, dim), strict=True):
                found, scores, times = block.top(q, v, k)
                mark = int.from_bytes(blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True)
                for column, x in zip(out, (np.full(len(found), q), np.full(len(found), mark), found, scores, times), strict=True):
                    column.append(x)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vector", "vec_id", "score", "times"])

    found = work.groupBy(*keys).applyInArrow(run, "query_id long, vector long, vec_id long, score long, times long")
    found = found.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))))  # no more than k of a row can count
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries: the rows whose id is divisible by `every`; candidates: every row."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v")).where("v is not null and vec_id is not null")
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)) v from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, q.v, c.vec_id, list_inner_product(q.v, c.v)::bigint score
    from (select distinct vec_id, v from v) q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
r as (select *, (row_number() over (partition by query_id, v order by score desc, vec_id))::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
