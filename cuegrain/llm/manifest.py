"""Merkle manifest of a dataset: checkpoint-and-recompute.

Each source is a tree over its rows in order of id, and the sources' roots, in order of source, are
the leaves of one more tree. A node is the SHA-256 of its up to ARITY children. Only every EVERY-th
level is written: a block of ARITY ** EVERY aligned nodes of a written level becomes one node of
the next. Proofs are extracted downwards: each block of a written level meets the proof of the node
above it, regenerates the levels between from its own nodes, gives each node its siblings, and the
regenerated nodes are discarded with the row. What is shuffled is a digest for each row and a proof
for each block, never texts.

Rows are numbered by a range sort: the place in a sorted partition, plus the rows of the same
source in partitions before it (one row for each partition and source). A source of any size is
dealt over as many partitions and blocks as its rows ask.

Defined cases: a null is `-` in a leaf, also a null id, which comes first in its source and is never
tampered with; a null source is a source of its own before all others; rows that share an id go by
leaf, and equal rows have equal leaves and are leaves each; texts of any length count whole; columns
beyond those of the leaf are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged

ARITY, EVERY = 3, 4
BLOCK = ARITY**EVERY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, concatenated, as lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(**replaced: Column) -> Column:
    return digest(*[field(replaced.get(name, F.col(name))) for name in FIELDS])


def tree_of(source: Column) -> Column:
    """Text that sorts like the source by its bytes, null first, and is never null."""
    return F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source))


def parents(nodes: Column) -> Column:
    """The level above a list of nodes: the digest of each run of ARITY."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def blocks(level: DataFrame, *carried: str) -> DataFrame:
    """The aligned blocks of a written level (tree, idx, node, size), with `_nodes0`.. regenerated and `_size0`.., the tree's nodes on each of these levels."""
    members = F.sort_array(F.collect_list(F.struct("idx", "node", *carried)))
    found = level.groupBy("tree", "size", F.expr(f"idx div {BLOCK}").alias("block")).agg(members.alias("_members"))
    found = found.withColumn("_nodes0", F.transform("_members", lambda x: x["node"])).withColumn("_size0", F.col("size"))
    for i in range(EVERY):
        up = F.when(F.col(f"_size{i}") > 1, parents(F.col(f"_nodes{i}"))).otherwise(F.col(f"_nodes{i}"))
        found = found.withColumn(f"_nodes{i + 1}", up).withColumn(f"_size{i + 1}", F.expr(f"(_size{i} + {ARITY - 1}) div {ARITY}"))
    return found


def climb(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The written levels (tree, idx, node, size) from the leaves to the roots; the last has one node for each tree."""
    levels = [leaves]
    while levels[-1].where("size > 1").limit(1).count():
        top = blocks(levels[-1].select("tree", "idx", "node", "size"))
        above = top.select("tree", F.col("block").alias("idx"), F.col(f"_nodes{EVERY}")[0].alias("node"), F.col(f"_size{EVERY}").alias("size"))
        levels.append(staged(above, f"{name}-level"))
    return levels


def siblings(i: int) -> Column:
    """What stands left and right of the block's member `_at` in its run on regenerated level `i`, if the tree has more levels."""
    nodes, at = F.col(f"_nodes{i}"), F.floor(F.col("_at") / ARITY**i).cast("int")
    first = F.floor(at / ARITY).cast("int") * ARITY
    left = F.array_join(F.slice(nodes, first + 1, at - first), "")
    right = F.array_join(F.slice(nodes, at + 2, first + (ARITY - 1) - at), "")
    return F.when(F.col(f"_size{i}") > 1, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array())


def descend(levels: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """The nodes of the lowest level with `proof`, their siblings from there on, and what `tops` (tree, proof, ...) says of their tree."""
    rest = [c for c in tops.columns if c not in ("tree", "proof")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(levels[:-1]):
        own = carried if level is levels[0] else ()
        met = blocks(level, *own).join(above, ["tree", "block"])
        one = met.select("*", F.posexplode("_members").alias("_at", "_member"))
        proof = F.concat(*[siblings(i) for i in range(EVERY)], "proof")
        above = one.select("tree", F.col("_member.idx").alias("block"), F.col("_member.node").alias("node"), *[F.col(f"_member.{c}").alias(c) for c in own], proof.alias("proof"), *rest)
    return above if len(levels) > 1 else levels[0].join(tops, "tree")


def fold(node: Column, proof: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(proof, node, lambda below, s: digest(s["left"], below, s["right"]))


def prove(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, leaf, tampered leaf (null: as it was), proof (siblings left and right, level by level), subroot and root."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(text=F.translate("text", "\n", "")))
    leaves = docs.select(*FIELDS).select("doc_id", tree_of(F.col("source")).alias("tree"), leaf().alias("node"), tampered.alias("tampered"))
    leaves = leaves.withColumn("tampered", F.when(F.col("tampered") != F.col("node"), F.col("tampered")))
    levels = climb(numbered(staged(leaves, "manifest-leaves"), ["doc_id", "node"], "manifest-sorted"), "manifest")
    subroots = levels[-1].select("tree", F.col("node").alias("subroot"))
    sources = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("subroot").alias("node")), ["source"], "manifest-sources")
    above = climb(sources, "manifest-sources")
    roots = above[-1].select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("node").alias("root"))
    tops = descend(above, roots, "source").select(F.col("source").alias("tree"), "proof", F.col("node").alias("subroot"), "root")
    return descend(levels, staged(tops, "manifest-tops"), "doc_id", "tampered").withColumnRenamed("node", "leaf")


def report(docs: DataFrame) -> DataFrame:
    proved = prove(docs)
    hashed = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = proved.select("doc_id", "leaf", "subroot", "root", hashed.alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(text if f == 'text' else f) for f in FIELDS)})"


#: CRC-32 of the id's digits, a bit at a time; one is null for a null id.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE = f"""
with recursive d as (select row_number() over () rid, doc_id, source, {_leaf("text")} leaf,
    case when {_CRC} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} end tampered from documents),
i as (select *, case when source is null then '0' else '1' || source end tree,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by source) n from d),
up as (select tree, 0 lev, idx, leaf h, n from i union all
    select tree, lev + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (n + 2) // 3 from up where n > 1 group by tree, lev, idx // 3, n),
sub as (select tree, h subroot, row_number() over (order by tree) - 1 idx, count(*) over () n from up where n = 1),
over_ as (select 0 lev, idx, subroot h, n from sub union all
    select lev + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (n + 2) // 3 from over_ where n > 1 group by lev, idx // 3, n),
s as (select i.rid, lev, coalesce(string_agg(h, '' order by up.idx) filter (up.idx < i.idx // (3 ** lev)::bigint), '') l,
    coalesce(string_agg(h, '' order by up.idx) filter (up.idx > i.idx // (3 ** lev)::bigint), '') r
    from i join up on i.tree = up.tree and up.n > 1 and up.idx // 3 = i.idx // (3 ** (lev + 1))::bigint group by all),
t as (select tree, lev, coalesce(string_agg(h, '' order by o.idx) filter (o.idx < sub.idx // (3 ** lev)::bigint), '') l,
    coalesce(string_agg(h, '' order by o.idx) filter (o.idx > sub.idx // (3 ** lev)::bigint), '') r
    from sub join over_ o on o.n > 1 and o.idx // 3 = sub.idx // (3 ** (lev + 1))::bigint group by all),
p as (select rid, lev, l, r from s union all select rid, 1000 + lev, l, r from i join t using (tree)),
q as (select rid, row_number() over (partition by rid order by lev) step, l, r from p),
f as (select rid, 0::bigint step, coalesce(tampered, leaf) h from i union all
    select f.rid, q.step, sha256(q.l || f.h || q.r) from f join q on q.rid = f.rid and q.step = f.step + 1),
e as (select rid, max_by(h, step) folded_root from f group by rid)
select doc_id, leaf, subroot, root, sha256(coalesce(x, '')) proof_sha256, folded_root, folded_root = root verified
from i join sub using (tree) cross join (select h root from over_ where n = 1) join e using (rid) left join (select rid, string_agg(l || r, '' order by step) x from q group by rid) using (rid)
"""
