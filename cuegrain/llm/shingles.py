"""N-gram Jaccard join by a MinHash LSH forest whose matched prefixes are shortened until the recall is met.

Texts are sets of hashed runs of five words; texts with one set are one class, told by a 128-bit
digest. A class has TREES labels of DEEPEST minima. The forest is the sorted prefix tries of those
labels: classes with one prefix of a label meet in a node. Pairs are met at the deepest prefix
first. Every pair that meets is verified on its two whole sets (shared * 5 >= union * 4), so the
links found and their similarities are exact, and from them the recall follows: a pair of
similarity s meets at depth k with the chance 1 - (1 - s**k)**TREES, so n links found of such pairs
stand for n over that chance. While the recall so measured is under RECALL, prefixes are shortened
to the deepest depth that would give it, and only pairs that did not meet deeper are verified. No
prefix need be shorter than prefix_depth(threshold): there even links right at the threshold meet
with that recall (3 minima at 0.8 in 24 trees: all but 4 in 10**8). So the first pass keeps only
nodes of that depth with two classes or more, and all tries are built on what is in those.

A pair is verified once: at the deepest depth, and there in the first tree, where it meets. A node
with the same classes as one of an earlier tree, or of a deeper level, is left out. A node of many
classes is cut in blocks bounded in classes and shingles, each packed and compressed as one row,
and a unit of work is two blocks; it counts links and gives a row for each linked class, never one
for each pair. Counting links takes time with n * n in a group of n different near copies, as the
count does; rows grow with (n / BLOCK_CLASSES)**2.

Result: per document class_id (the least id that links connect it to), copy_of (the least id with
its set), n_copies (documents with its set, itself too), n_links (other documents at or above
the threshold: copies and documents of linked classes) and n_linked_classes.

Defined cases: words are runs without ASCII white space, compared as they stand; a text of one to
four words is one run of all of them; a null, empty or blank text has no set, links to nothing and
is its own class, which dedup() keeps; a null id is counted like any other document and is never a
class's id unless no member has one; rows that share an id are documents each, told by id and text
hash; of equal rows dedup() keeps one; other columns are not needed; an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, join_hot, pieces, ship, staged
from .graph import components
from .hashing import mix, shingle_hashes, word_hashes

WIDTH = 5
THRESHOLD = (4, 5)
TREES, DEEPEST, RECALL = 24, 8, 0.9999999
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 400_000
NO_ID = -(1 << 63)
#: Similarities of links are counted in steps of 1 / STEPS.
STEPS = 50


def meets(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix that still gives the recall."""
    k = deepest
    while k > 1 and meets(similarity, k, trees) < recall:
        k -= 1
    return k


def next_depth(found: dict[int, int], depth: int, shortest: int, recall: float = RECALL) -> int:
    """The depth to shorten prefixes to, or `depth` if the recall is met.

    `found` counts, by similarity in steps of 1 / STEPS, the links met at `depth` or deeper. Those
    similarities are rounded down, and one link right at the threshold is always thought to be there.
    """
    least = THRESHOLD[0] / THRESHOLD[1]
    at = {s: n / meets(s, depth) for s, n in ((max(least, b / STEPS), n) for b, n in found.items())}
    at[least] = at.get(least, 0.0) + 1.0
    total = sum(at.values())
    for k in range(depth, shortest, -1):
        if sum(n * meets(s, k) for s, n in at.items()) >= recall * total:
            return k
    return shortest


_random = np.random.default_rng(97)
_ODD = _random.integers(0, 1 << 63, (DEEPEST, TREES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, (DEEPEST, TREES), dtype=np.uint64)


def labels(shingles: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` minima of each tree's label: depth x trees."""
    odd, add = _ODD[:depth].ravel(), _ADD[:depth].ravel()
    low = np.full(len(odd), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 8192):
        np.minimum(low, (shingles[i : i + 8192, None] * odd[None, :] + add[None, :]).min(axis=0), out=low)
    return low.reshape(depth, TREES)


def prefixes(label: np.ndarray) -> np.ndarray:
    """A key of each tree's prefix at each depth: depths x trees."""
    key = np.arange(TREES, dtype=np.uint64)
    out = np.empty(label.shape, dtype=np.uint64)
    for j in range(len(label)):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + label[j])
        out[j] = key
    return out


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    words, edges = word_hashes(texts)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield shingle_hashes(words[a:b], WIDTH)


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums of its mixed hashes."""
    return np.array([mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() ^ np.uint64(len(s))], dtype=np.uint64).tobytes()


def row_key(docs: DataFrame) -> DataFrame:
    """doc_id, what tells rows apart (id0, mark), and the text."""
    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(NO_ID)).alias("id0"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def signatures(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, id0, mark, digest (null without words), n (shingles) and keys (one a tree, of prefixes of that depth)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(3)):
                digest, size, keys = [], [], []
                for s in _sets(batch.column(3).slice(a, b - a).to_pylist()):
                    digest.append(_digest(s) if len(s) else None)
                    size.append(len(s))
                    keys.append(prefixes(labels(s, depth))[-1].view(np.int64).tolist() if len(s) else None)
                made = [pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(3)] + made, names=["doc_id", "id0", "mark", "digest", "n", "keys"])

    return row_key(docs).mapInArrow(run, "doc_id long, id0 long, mark long, digest binary, n int, keys array<bigint>")


def classes(signed: DataFrame) -> DataFrame:
    """One row for each distinct set: digest, rep (its least id), id0 and mark of a row that has it, copies, n, keys."""
    found = signed.where("digest is not null").groupBy("digest")
    at = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "id0", "mark"))
    found = found.agg(F.min("doc_id").alias("rep"), at.alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    return found.select("digest", "rep", F.col("at.id0").alias("id0"), F.col("at.mark").alias("mark"), "copies", "n", "keys")


def forest(docs: DataFrame, reps: DataFrame, shortest: int) -> DataFrame:
    """Classes that share some tree's shortest prefix with another: digest, copies, n, prefixes (depth by depth), shingles."""
    placed = reps.select("digest", F.posexplode("keys").alias("tree", "key"))
    crowded = staged(placed.groupBy("tree", "key").agg(F.count("*").alias("c")).where("c > 1"), "forest-roots")
    members = staged(join_hot(placed, crowded, ["tree", "key"], "c").where("c is not null").select("digest").distinct(), "forest-classes")
    wanted = staged(reps.select("digest", "id0", "mark", "copies", "n").join(members, "digest", "left_semi"), "forest-classes")
    # equal rows hold the same text: one of them
    texts = row_key(docs).select("id0", "mark", "text").join(wanted.select("id0", "mark"), ["id0", "mark"], "left_semi").dropDuplicates(["id0", "mark"])
    texts = texts.select("id0", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2)):
                keys, packed = [], []
                for s in _sets(batch.column(2).slice(a, b - a).to_pylist()):
                    keys.append(prefixes(labels(s, DEEPEST))[shortest - 1 :].ravel().view(np.int64))
                    packed.append(s.tobytes())
                made = [pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(2)] + made, names=["id0", "mark", "prefixes", "shingles"])

    made = texts.mapInArrow(run, "id0 long, mark long, prefixes array<bigint>, shingles binary")
    return staged(wanted.join(made.hint("shuffle_merge"), ["id0", "mark"]).select("digest", "copies", "n", "prefixes", "shingles"), "forest")


class Block:
    """Some classes of a node: what a unit of work compares."""

    def __init__(self, table: pa.Table):
        matrix = lambda name: table[name].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        self.digest = table["digest"].to_pylist()
        self.copies = table["copies"].to_numpy().astype(np.int64)
        self.here, self.deeper = matrix("here"), matrix("deeper")
        self.packed = table["shingles"] if "shingles" in table.column_names else None

    def sets(self) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in self.packed]


def _shared(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs (a mask of left x right)."""
    out = np.zeros(pairs.shape, dtype=np.int64)
    if pairs.sum() <= 48:
        for x, y in zip(*np.nonzero(pairs), strict=True):
            out[x, y] = len(np.intersect1d(left[x], right[y], assume_unique=True))
        return out
    keep_l, keep_r = np.flatnonzero(pairs.any(axis=1)), np.flatnonzero(pairs.any(axis=0))
    flat_l, flat_r = np.concatenate([left[x] for x in keep_l]), np.concatenate([right[y] for y in keep_r])
    common = np.intersect1d(flat_l, flat_r)
    if not len(common):
        return out

    def columns(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        return rows[hit], at[hit]

    (rl, cl), (rr, cr) = columns(flat_l, [left[x] for x in keep_l]), columns(flat_r, [right[y] for y in keep_r])
    total = np.zeros((len(keep_l), len(keep_r)), dtype=np.float32)
    step = 4096
    order_l, order_r = np.argsort(cl, kind="stable"), np.argsort(cr, kind="stable")
    rl, cl, rr, cr = rl[order_l], cl[order_l], rr[order_r], cr[order_r]
    for i in range(0, len(common), step):
        a, b = np.searchsorted(cl, (i, i + step)), np.searchsorted(cr, (i, i + step))
        m = np.zeros((len(keep_l), step), dtype=np.float32)
        w = np.zeros((len(keep_r), step), dtype=np.float32)
        m[rl[a[0] : a[1]], cl[a[0] : a[1]] - i] = 1
        w[rr[b[0] : b[1]], cr[b[0] : b[1]] - i] = 1
        total += m @ w.T
    out[np.ix_(keep_l, keep_r)] = total.astype(np.int64)
    return out


def _wanted(tree: int, left: Block, right: Block) -> np.ndarray:
    """Pairs that share this tree's prefix, none of an earlier tree, and none that was met deeper."""
    wanted = left.here[:, tree][:, None] == right.here[:, tree][None, :]
    for i in range(tree):
        wanted &= left.here[:, i][:, None] != right.here[:, i][None, :]
    for i in range(left.deeper.shape[1]):
        wanted &= left.deeper[:, i][:, None] != right.deeper[:, i][None, :]
    return np.triu(wanted, 1) if left is right else wanted


LINKS = "digest binary, links long, documents long, root binary, step int, pairs long"


def _links(tree: int, left: Block, right: Block) -> pa.Table:
    """For each class with links in this unit their number, its documents' and a class it is linked to; then links by similarity."""
    n, m = len(left.digest), len(right.digest)
    links, documents = np.zeros(n + m, dtype=np.int64), np.zeros(n + m, dtype=np.int64)
    root = np.arange(n + m)
    wanted = _wanted(tree, left, right)
    by_step: dict[int, int] = {}
    if wanted.any():
        a, b = left.sets(), right.sets()
        size_a, size_b = (np.array([len(s) for s in x], dtype=np.int64) for x in (a, b))
        shared = _shared(a, b, wanted)
        union = size_a[:, None] + size_b[None, :] - shared
        near = wanted & (shared * THRESHOLD[1] >= union * THRESHOLD[0])
        links[:n], links[n:] = near.sum(axis=1), near.sum(axis=0)
        documents[:n], documents[n:] = near @ right.copies, near.T @ left.copies
        steps, counts = np.unique(shared[near] * STEPS // union[near], return_counts=True)
        by_step = dict(zip(steps.tolist(), counts.tolist(), strict=True))
        xs, ys = np.nonzero(near)
        ys = ys + (0 if left is right else n)
        while len(xs):  # least label over links until none changes
            low = np.minimum(root[xs], root[ys])
            before = root.copy()
            np.minimum.at(root, xs, low)
            np.minimum.at(root, ys, low)
            root = root[root]
            if (root == before).all():
                break
    if left is right:
        links, documents = links[:n] + links[n:], documents[:n] + documents[n:]
    digest = left.digest if left is right else left.digest + right.digest
    at = np.flatnonzero(links).tolist()
    none = [None] * len(at)
    rows = {
        "digest": pa.array([digest[i] for i in at] + [None] * len(by_step), pa.binary()),
        "links": pa.array(links[at].tolist() + [None] * len(by_step), pa.int64()),
        "documents": pa.array(documents[at].tolist() + [None] * len(by_step), pa.int64()),
        "root": pa.array([digest[root[i]] for i in at] + [None] * len(by_step), pa.binary()),
        "step": pa.array(none + list(by_step), pa.int32()),
        "pairs": pa.array(none + list(by_step.values()), pa.int64()),
    }
    return pa.table(rows)


def _needed(key: tuple, table: pa.Table) -> pa.Table:
    """The classes of a node that are in a pair to verify, by their prefixes alone."""
    block = Block(table)
    wanted = _wanted(key[0].as_py(), block, block)
    return table.select(["digest", "tree", "key"]).take(pa.array(np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))))


def _node(key: tuple, table: pa.Table) -> pa.Table:
    """Links among the classes of one node."""
    block = Block(table)
    return _links(key[0].as_py(), block, block)


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """A block of a node as one compressed row."""
    sink = pa.BufferOutputStream()
    body = table.select(["digest", "copies", "here", "deeper", "shingles"])
    with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(body)
    tree, node, block = (x.as_py() for x in key)
    return pa.table({"tree": pa.array([tree], pa.int32()), "key": [node], "block": pa.array([block], pa.int32()), "blocks": table["blocks"].slice(0, 1), "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _two_blocks(key: tuple, table: pa.Table) -> pa.Table:
    """Links between two blocks of a node, or within one."""
    blocks = [Block(pa.ipc.open_stream(x.as_buffer()).read_all()) for x in table.sort_by("block")["packed"]]
    return _links(key[0].as_py(), blocks[0], blocks[-1])


def level(tries: DataFrame, depth: int, deeper: int | None, shortest: int, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Links of pairs that meet at `depth` and did not at `deeper`, and the nodes so far (their members as hashes)."""
    slice_ = lambda k: F.slice("prefixes", (k - shortest) * TREES + 1, TREES)
    placed = tries.select("digest", "n", F.posexplode(slice_(depth)).alias("tree", "key"))
    member = F.xxhash64("digest"), F.xxhash64("digest", F.lit("again"))
    nodes = placed.groupBy("tree", "key").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"), *[F.bit_xor(x).alias(f"x{i}") for i, x in enumerate(member)]).where("c > 1")
    same = ["c", "x0", "x1"]
    nodes = nodes.withColumn("_first", F.row_number().over(Window.partitionBy(*same).orderBy("tree"))).where("_first = 1")
    if known is not None:
        nodes = nodes.join(known, same, "left_anti")
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK_CLASSES, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    nodes = staged(nodes.select("tree", "key", *same, blocks.alias("blocks")), "forest-nodes")
    members = join_hot(placed.select("digest", "tree", "key"), nodes.select("tree", "key", "c", "blocks"), ["tree", "key"], "c").where("c is not null")
    full = tries.select("digest", "copies", "shingles", slice_(depth).alias("here"), (slice_(deeper) if deeper else F.array().cast("array<bigint>")).alias("deeper"))
    # sets are sent only to nodes, and only of classes, that have a pair to verify; what grows with the
    # corpus is joined by shuffle at every size, so that small runs show how large ones behave
    small = members.where("blocks = 1").select("digest", "tree", "key").join(full.drop("shingles").hint("shuffle_merge"), "digest")
    needed = staged(small.groupBy("tree", "key").applyInArrow(_needed, "digest binary, tree int, key long"), "forest-needed")
    found = needed.join(full.hint("shuffle_merge"), "digest").groupBy("tree", "key").applyInArrow(_node, LINKS)
    if (nodes.agg(F.max("blocks")).first()[0] or 0) > 1:
        own = F.pmod(F.xxhash64("digest", "key"), F.col("blocks")).cast("int")
        packed = members.where("blocks > 1").join(full.hint("shuffle_merge"), "digest").withColumn("block", own).groupBy("tree", "key", "block").applyInArrow(_pack, "tree int, key long, block int, blocks int, packed binary")
        pairs = staged(packed, "forest-blocks").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        found = found.unionByName(pairs.groupBy("tree", "key", "lo", "hi").applyInArrow(_two_blocks, LINKS))
    nodes = nodes.select(*same)
    return staged(found, "links"), nodes if known is None else nodes.unionByName(known)


def links(docs: DataFrame, reps: DataFrame, recall: float = RECALL) -> DataFrame:
    """digest, links, documents, root: rows of linked classes, from the deepest prefixes to those that give the recall."""
    shortest = prefix_depth(THRESHOLD[0] / THRESHOLD[1], recall=recall)
    tries = forest(docs, reps, shortest)
    if tries.isEmpty():
        return tries.select("digest", *[F.lit(0).cast("long").alias(n) for n in ("links", "documents")], F.col("digest").alias("root"))
    found, nodes, depth, deeper = None, None, DEEPEST, None
    while True:
        more, nodes = level(tries, depth, deeper, shortest, nodes)
        found = more if found is None else found.unionByName(more)
        steps = found.where("step is not null").groupBy("step").agg(F.sum("pairs")).collect()  # no more than STEPS rows
        shorter = next_depth({r[0]: r[1] for r in steps}, depth, shortest, recall)
        if shorter == depth:
            return found.where("digest is not null").select("digest", "links", "documents", "root")
        depth, deeper = shorter, depth


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and per class (digest) rep, copies, links, documents, root and class_id, the least id of its component."""
    signed = staged(signatures(docs, prefix_depth(THRESHOLD[0] / THRESHOLD[1])), "signatures")
    reps = staged(classes(signed), "classes")
    found = links(docs, reps)
    roots = components(found.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    counted = found.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    per_class = reps.select("digest", "rep", "copies").join(counted, "digest", "left").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    per_class = staged(per_class.withColumn("root", F.coalesce("root", "digest")), "class-links")
    least = staged(per_class.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("members")).where("members > 1"), "components")
    whole = join_hot(per_class, least, "root", "members").drop("members").withColumn("class_id", F.coalesce("class_id", "rep"))
    return signed, staged(whole, "class-links")


def join(docs: DataFrame) -> DataFrame:
    signed, per_class = linked(docs)
    both = join_hot(signed.select("doc_id", "digest"), per_class, "digest", "copies")
    one = F.lit(1).cast("long")
    return both.select(
        "doc_id",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("rep")).alias("copy_of"),
        F.coalesce("copies", one).alias("n_copies"),
        (F.coalesce("copies", one) - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_linked_classes"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class: that with the least id, and of rows that share it that with the least text hash."""
    signed, per_class = linked(docs)
    rows = join_hot(signed.where("digest is not null").select("doc_id", "id0", "mark", "digest"), per_class.select("digest", "root", "copies"), "digest", "copies")
    rows = staged(rows.groupBy("root", "doc_id", "id0", "mark").agg(F.count("*").alias("times")), "class-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "id0", "mark")
    first = staged(rows.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("members")), "class-firsts")
    judged = join_hot(rows, first, "root", "members").withColumn("stays", (F.col("id0") == F.col("first.id0")) & (F.col("mark") == F.col("first.mark")))
    judged = staged(judged.where("not stays or times > 1").select("id0", "mark", "stays"), "class-copies")
    id0, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))
    source = docs.select(id0.alias("id0"), mark.alias("mark"), F.struct(*map(col, docs.columns)).alias("_row"))
    # by shuffle at every size, as both sides grow with the corpus
    others = source.join(judged.select("id0", "mark").hint("shuffle_merge"), ["id0", "mark"], "left_anti")
    if judged.where("stays").isEmpty():
        return others.select("_row.*")
    # rows that are equal in all that tells rows apart: one of them stays
    one = source.join(judged.where("stays").select("id0", "mark"), ["id0", "mark"], "left_semi").dropDuplicates(["id0", "mark"])
    return others.unionByName(one).select("_row.*")
