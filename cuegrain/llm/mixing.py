"""Mixing sources to target weights by systematic sampling.

Each source has a target; its documents' expected copies, target over source size, are summed in
a fixed order (size class, then salt, then size and id), one random offset is added, and a
document is emitted once for each integer that its own step crosses. Order by size class makes
the words taken follow the target closely, since each class gives its share.

The prefix sums are hierarchical: rows are counted per (source, size class, salt), a window over
those counts gives where each such group begins, and a rank within the group gives the rest. The
salt count follows the row count, so a source that holds most rows is ranked in many tasks. The
salt is taken from the id, from the text where that is null, so rows without ids are dealt too.

Defined cases: a null text has size 0; a null source is a source of its own, after all others;
documents of size 0 and copies of a document are sampled like any other; a source whose sizes
sum to 0 has target 0 and no copies; rows that share an id go by a hash of their texts, each with
its own copies; equal rows may swap places, which no output shows; columns of any name stay; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, staged

WEIGHTS = (3.0, 1.0, 2.0)
SEED = "mix-1"
ROWS_A_SALT, MOST_SALTS = 2048, 4096


def size_class(size: Column) -> Column:
    """Four classes for each power of two, from the first three binary digits."""
    bits = F.bin(size)
    return F.length(bits) * 4 + F.conv(F.substring(F.concat(bits, F.lit("00")), 2, 2), 2, 10).cast("int")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`sources` (src, source_size, n) with `target`: weights by rank, capped, the excess reshared by weight.

    In order of cap over weight, a source is capped if its cap is no more than its weight's part
    of what the sources before it leave. One row for each source passes through this window.
    """
    by_name, by_ratio = Window.orderBy("src"), Window.orderBy("ratio", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("ratio", F.col("source_size") * most / F.col("weight"))
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / weight_left)
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "src", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least(F.col("source_size") * most, F.coalesce(free * F.col("weight"), F.col("source_size") * most)))


def offset(src: Column) -> Column:
    """The one random offset of a source, in 1/65536."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), src)), 1, 4), 16, 10).cast("long") / 65536.0


def copies(df: DataFrame, id_col: str = "doc_id", most: float = 2.0) -> DataFrame:
    """`df` (with src, size, mark, a hash of the text) with source_size, target and copies."""
    sized = df.withColumn("_class", size_class(F.col("size")))
    rows = sized.count()
    salts = max(1, min(MOST_SALTS, -(-rows // ROWS_A_SALT)))
    sized = sized.withColumn("_salt", F.pmod(F.coalesce(F.col(id_col).cast("long"), "mark"), F.lit(salts)))
    groups = sized.groupBy("src", "_class", "_salt").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    groups = staged(groups, "mix-groups")
    sources = targets(groups.groupBy("src").agg(F.sum("_size").alias("source_size"))).select("src", "source_size", "target")
    before = Window.partitionBy("src").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_size").join(sources, "src")
    order = Window.partitionBy("src", "_class", "_salt").orderBy("size", id_col, "mark")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda i: F.floor(offset(F.col("src")) + step * i)
    ranked = sized.join(starts, ["src", "_class", "_salt"]).withColumn("_i", F.col("_before") + F.row_number().over(order))
    found = F.least(crossed(F.col("_i")) - crossed(F.col("_i") - 1), F.lit(int(most)))
    return ranked.withColumn("copies", found.cast("int")).drop("_class", "_salt", "_before", "_i")


def source_key(source: Column) -> Column:
    """Text that sorts like the source by code point, null last, and joins where null would not."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def plan(docs: DataFrame) -> DataFrame:
    """One small row for each document: its size, its source's size and target, its copies."""
    small = docs.select(
        "doc_id",
        source_key(F.col("source")).alias("src"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("mark"),
    )
    return copies(staged(small, "mix-sizes"))


def mix(docs: DataFrame) -> DataFrame:
    """`docs` mixed: each row as often as its copies; rows without copies go.

    Whole rows are ranked in their salted groups, so they are shuffled once and need no join by id.
    """
    sized = docs.select(
        "doc_id",
        source_key(F.col("source")).alias("src"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("mark"),
        F.struct(*map(col, docs.columns)).alias("_row"),
    )
    chosen = copies(sized).where("copies > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def report(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = rf"""
with d as (select doc_id, case when source is null then '1' else '0' || source end src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
k as (select *, len(bin(size)) * 4 + case substr(bin(size) || '00', 2, 2) when '00' then 0 when '01' then 1 when '10' then 2 else 3 end cls,
    coalesce(doc_id, 0) % (select greatest(1, least({MOST_SALTS}, (count(*) + {ROWS_A_SALT - 1}) // {ROWS_A_SALT})) from d) salt from d),
s as (select src, sum(size)::bigint source_size from k group by src),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by src) - 1) % 3 + 1)::int]::double weight from s),
r as (select *, source_size * 2.0::double / weight ratio from w),
l as (select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(source_size * 2.0::double) over (order by ratio, src rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, src rows between unbounded preceding and 1 preceding), 0)) lvl from r),
t as (select src, source_size, least(source_size * 2.0::double, coalesce((select lvl from l where ratio > lvl order by ratio, src limit 1) * weight, source_size * 2.0::double)) target from l),
i as (select k.*, row_number() over (partition by src order by cls, salt, size, doc_id) i from k),
c as (select i.*, source_size, target, case when source_size > 0 then target / source_size else 0 end step,
    ('0x' || substr(md5('{SEED}' || src), 1, 4))::bigint / 65536.0::double u from i join t using (src)),
n as (select *, least(floor(u + step * i) - floor(u + step * (i - 1)), 2)::int copies from c)
select doc_id, size, source_size, target, (copies * size)::bigint taken, copies from n
"""
