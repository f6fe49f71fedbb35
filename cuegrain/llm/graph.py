"""Connected components by large-star and small-star rounds, each a minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, staged


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("c")), "stars")
    return join_hot(both, least, "u", "c", total=2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    least = staged(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "stars")
    moved = join_hot(down, least, "u", "c", total=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (u, v): the least node it can reach. Rounds until none changes.

    The node in the middle of a star has as many edges as the star has nodes: such nodes are joined
    by broadcast, of which there are few at once.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = (now.count(), None)
    while state[0]:
        now = staged(_small(_large(now, state[0]), state[0]), "edges")
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
