"""Ranked lexical search over a document FP-tree with branch-and-bound.

Documents are reduced to the terms that some item asks for, each vector ordered by document
frequency, most frequent first, so that vectors share the paths of a prefix tree. A node covers the
documents below it and knows, for each term that one of them holds, the largest tf, and their
smallest m (the length measure): a score grows with tf and falls with m, so these bound every score
below. The search walks a tree depth first, best bound first, for all items of a pack at once, each
item with its own best documents so far; a branch is left when its bound reaches the worst of the
best for no item. A branch of one vector has its exact score as bound.

Texts are read once a pack of items, in Arrow batches; what is written for a document is its id, its
length and its numbers and counts of asked terms. No text, term or vector is shuffled: a task builds
trees over blocks of bounded size of its part, keeps each item's best over them, and only these meet.
A pack has at most PACK_TERMS terms over all its items (or one item), so what goes to the tasks is
bounded; more items are more packs, each a pass over the documents.

Defined cases: a null or empty text has no terms, and as an item no results; items that share an id
(also a null one) are one item, with the terms of all their texts; rows of documents are candidates
each, also repeated ones and those that share an id; at equal scores null ids come last; a text of
any length is counted in pieces; columns of any name may stand beside those read; an empty table
gives an empty one.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import mapped, pieces, ship, staged

TOP = 10
PACK_TERMS, PACK_ITEMS = 1 << 17, 1 << 12
#: A tree is built over at most so many documents, or so many entries of their vectors.
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1 << 20
#: A term is a run of ASCII letters and digits and of all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8 bytes: what is in no term becomes a blank, A-Z become a-z.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_CHUNK = 1 << 20
_NO_ID = np.iinfo(np.int64).max


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term, as bytes; a long text is cut between terms."""
    found, at = Counter(), 0
    while at < len(text):
        end = min(len(text), at + _CHUNK)
        part = text[at:end].translate(_BYTES)
        while end < len(text) and part[-1:] != b" ":  # to the end of the term
            more = text[end : end + 4096].translate(_BYTES)
            stop = more.find(b" ") + 1 or len(more)
            part += more[:stop]
            end += stop
        found.update(part.split())
        at = end
    return found


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats) and the numbers and counts of the vocabulary's terms, for documents with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for a, b in pieces(texts):
                rows, lengths, ends, terms, counts = [], [], [0], [], []
                for i in range(a, b):
                    found = term_counts(texts[i].as_py() or b"")
                    if found:
                        hits = [(vocabulary[t], c) for t, c in found.items() if t in vocabulary]
                        rows.append(i)
                        lengths.append(found.total())
                        terms += [t for t, _ in hits]
                        counts += [c for _, c in hits]
                        ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, counts)]
                yield pa.RecordBatch.from_arrays([kept.take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=["_row", "n", "terms", "counts"])

    ints = T.ArrayType(T.IntegerType())
    return mapped(docs, ["doc_id"], F.col("text"), run, [("n", T.LongType()), ("terms", ints), ("counts", ints)])


class Pack(NamedTuple):
    """What the search of one pack of items needs: terms are numbered by falling document frequency."""

    ids: list  # of items
    number: np.ndarray  # of each vocabulary term, by its number in the vectors
    weight: np.ndarray  # of each term
    starts: np.ndarray  # where each term's items begin in `askers`
    askers: np.ndarray
    documents: int
    terms: int


def gains(weight: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Tree:
    """A prefix tree over term vectors; node 0 is the root and children follow their parent.

    Vectors equal in terms, counts and m are one leaf with all their ids, in order.
    """

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], m: list[int], ids: list[int]):
        keys = [(t.astype(">i4").tobytes(), c.astype(">i4").tobytes(), mm) for t, c, mm in zip(terms, counts, m, strict=True)]
        order = sorted(range(len(keys)), key=lambda i: (keys[i], ids[i]))
        first, self.ids = [], []
        for i in order:
            if first and keys[first[-1]] == keys[i]:
                self.ids[-1].append(ids[i])
            else:
                first.append(i)
                self.ids.append([ids[i]])
        shared = np.zeros(len(first), dtype=np.int64)  # terms that a vector's path shares with the one before
        for j in range(1, len(first)):
            a, b = terms[first[j - 1]], terms[first[j]]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            shared[j] = differ[0] if len(differ) else k
        self.leaf: list[int] = []  # the leaf that a node is, or -1
        self.children: list[list[int]] = []
        spans = [(0, len(first), -1)]
        while spans:
            lo, hi, parent = spans.pop()
            node = len(self.leaf)
            self.leaf.append(lo if hi - lo == 1 else -1)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if hi - lo > 1:
                inner = shared[lo + 1 : hi]
                cuts = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
                spans += [(a, b, node) for a, b in zip(cuts, cuts[1:])]
        size = 1 + max(int(t[-1]) if len(t) else 0 for t in terms)
        most = np.zeros(size, dtype=np.int64)
        nodes = len(self.leaf)
        self.terms: list[np.ndarray] = [None] * nodes
        self.most: list[np.ndarray] = [None] * nodes  # the largest count of each term below
        self.m, self.first = [0] * nodes, [0] * nodes  # the smallest m and id below
        for node in range(nodes - 1, -1, -1):
            leaf, below = self.leaf[node], self.children[node]
            if leaf >= 0:
                i = first[leaf]
                self.terms[node], self.most[node], self.m[node], self.first[node] = terms[i], counts[i].astype(np.int64), m[i], self.ids[leaf][0]
                continue
            for c in below:
                t = self.terms[c]
                most[t] = np.maximum(most[t], self.most[c])
            union = np.unique(np.concatenate([self.terms[c] for c in below]))
            self.terms[node], self.most[node] = union, most[union]
            most[union] = 0
            self.m[node], self.first[node] = min(self.m[c] for c in below), min(self.first[c] for c in below)


class Best:
    """Each item's best documents so far, and the least that a document must have to be among them."""

    def __init__(self, pack: Pack, top: int):
        self.pack, self.top = pack, top
        self.found: list[list[tuple[int, int]]] = [[] for _ in pack.ids]  # (-score, id), best first
        self.score = np.zeros(len(pack.ids), dtype=np.int64)
        self.id = np.full(len(pack.ids), _NO_ID, dtype=np.int64)

    def bounds(self, tree: Tree, node: int) -> tuple[np.ndarray, np.ndarray]:
        """The items for which a document below the node could still be among the best, and their bounds."""
        p, terms = self.pack, tree.terms[node]
        gain = gains(p.weight[terms], tree.most[node], tree.m[node])
        starts = p.starts[terms]
        n = p.starts[terms + 1] - starts
        at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
        bound = np.zeros(len(p.ids), dtype=np.int64)
        np.add.at(bound, p.askers[at], np.repeat(gain, n))
        live = np.flatnonzero(self.reach(slice(None), bound, tree.first[node]))
        return live, bound[live]

    def reach(self, items, bound: np.ndarray, first: int) -> np.ndarray:
        return (bound > self.score[items]) | ((bound == self.score[items]) & (bound > 0) & (first < self.id[items]))

    def search(self, tree: Tree) -> None:
        stack = [(0, *self.bounds(tree, 0))]
        while stack:
            node, items, bound = stack.pop()
            live = self.reach(items, bound, tree.first[node])
            if not live.any():
                continue
            if tree.leaf[node] >= 0:
                for item, score in zip(items[live].tolist(), bound[live].tolist()):
                    self.add(item, score, tree.ids[tree.leaf[node]])
                continue
            below = [(c, *self.bounds(tree, c)) for c in tree.children[node]]
            stack += sorted((b for b in below if len(b[1])), key=lambda b: int(b[2].max()))

    def add(self, item: int, score: int, ids: list[int]) -> None:
        found = self.found[item]
        for i in ids[: self.top]:
            entry = (-score, i)
            if len(found) == self.top:
                if entry >= found[-1]:
                    break
                found.pop()
            bisect.insort(found, entry)
        if len(found) == self.top:
            self.score[item], self.id[item] = -found[-1][0], found[-1][1]


def best_of(vecs: DataFrame, pack: Pack, item_type: T.DataType, top: int) -> DataFrame:
    """Each task's best documents for each item: item_id, doc_id, score."""
    id_type = vecs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block, entries, kinds = Best(pack, top), ([], [], [], []), 0, None

        def flush():
            if block[0]:
                best.search(Tree(*block))
                for part in block:
                    part.clear()

        for batch in batches:
            kinds = batch.column(0).type
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            terms, counts = batch.column(2), batch.column(3)
            ends = terms.offsets.to_numpy()
            numbers, tfs = pack.number[terms.values.to_numpy()], counts.values.to_numpy()
            tf_ends = counts.offsets.to_numpy()
            for i in range(len(ids)):
                own = numbers[ends[i] : ends[i + 1]]
                order = np.argsort(own)
                block[0].append(own[order])
                block[1].append(tfs[tf_ends[i] : tf_ends[i + 1]][order])
                block[2].append(10 + 90 * lengths[i] * pack.documents // pack.terms)
                block[3].append(_NO_ID if ids[i] is None else ids[i])
                entries += len(own)
                if len(block[0]) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    flush()
                    entries = 0
        flush()
        rows = [(pack.ids[i], None if d == _NO_ID else d, -s) for i, found in enumerate(best.found) for s, d in found]
        if rows:
            items, docs, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(items, item_kind), pa.array(docs, kinds), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

    item_kind = to_arrow_type(item_type)
    return vecs.select("doc_id", "n", "terms", "counts").mapInArrow(run, schema)


def packs(items: DataFrame, pack_terms: int = PACK_TERMS, pack_items: int = PACK_ITEMS) -> tuple[DataFrame, int]:
    """`items` as item_id, terms and pack, written, and the number of packs: doubled until each is within its bounds or one item."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = items.select("item_id", F.explode(terms).alias("term")).distinct()
    lists = staged(asked.groupBy("item_id").agg(F.collect_list("term").alias("terms")), "search-items")
    number = 1
    while True:
        dealt = lists.withColumn("pack", F.pmod(F.xxhash64(F.col("item_id"), F.lit(number)), F.lit(number)))
        sizes = dealt.groupBy("pack").agg(F.sum(F.size("terms")).alias("terms"), F.count("*").alias("items"))
        if not sizes.where((F.col("items") > 1) & ((F.col("terms") > pack_terms) | (F.col("items") > pack_items))).limit(1).count():
            return dealt, number
        number *= 2


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pack_terms: int = PACK_TERMS, pack_items: int = PACK_ITEMS) -> DataFrame:
    """The `top` documents of `docs` (doc_id, text) for each of `items` (item_id, text): item_id, rank, doc_id, score."""
    ship(docs.sparkSession)
    asked, number = packs(items, pack_terms, pack_items)
    item_type, found = items.schema["item_id"].dataType, None
    for p in range(number):
        rows = sorted(asked.where(F.col("pack") == p).select("item_id", "terms").collect(), key=lambda r: (r.item_id is None, r.item_id))  # within the pack's bounds
        if not rows:
            continue
        vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for r in rows for t in r.terms}))}
        vecs = staged(vectors(docs, vocabulary), "search-vectors")
        total = vecs.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in vecs.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each term of the pack
            df[r.t] = r["count"]
        order = np.lexsort((np.arange(len(df)), -df))
        place = np.empty(len(df), dtype=np.int32)
        place[order] = np.arange(len(df), dtype=np.int32)
        weight = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * n + 1))) for n in df[order].tolist()], dtype=np.int64)
        pairs = sorted((int(place[vocabulary[t.encode()]]), i) for i, r in enumerate(rows) for t in r.terms)
        numbers = np.array([n for n, _ in pairs], dtype=np.int64)
        pack = Pack([r.item_id for r in rows], place, weight, np.searchsorted(numbers, np.arange(len(df) + 1)), np.array([i for _, i in pairs], dtype=np.int64), total.documents, total.terms or 1)
        part = best_of(vecs.where(F.size("terms") > 0), pack, item_type, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        names = [T.StructField("item_id", item_type), docs.schema["doc_id"], T.StructField("score", T.LongType())]
        found = docs.sparkSession.createDataFrame([], T.StructType(names))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"

ORACLE = rf"""
with d as (select row_number() over () rid, doc_id, {_TERMS} w from documents where text is not null),
tot as (select count(*) docs, sum(len(w))::bigint terms from d where len(w) > 0),
q as (select distinct item_id, unnest(w) t from (select item_id, {_TERMS} w from benchmark where text is not null)),
v as (select distinct t from q),
tf as (select rid, doc_id, t, n, count(*) tf from (select rid, doc_id, len(w) n, unnest(w) t from d) semi join v using (t) group by all),
df as (select t, count(*) df from tf group by t),
s as (select item_id, rid, doc_id, sum(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint score
    from q join tf using (t) join df using (t) cross join tot group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) rank from s where score > 0)
select item_id, rank::int rank, doc_id, score from r where rank <= {TOP}
"""
