"""Merging snapshots of edits, latest states, work items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _side(edits: DataFrame, snapshot: str, name: str) -> DataFrame:
    return edits.where(F.col("snapshot") == snapshot).select("conv_id", "turn", F.col("v").alias(name), F.lit(True).alias(f"in_{name}"))


def snapshots(edits: DataFrame) -> DataFrame:
    """One row for each leaf of any snapshot: base, local, remote and which have it."""
    keys = ["conv_id", "turn"]
    j = _side(edits, "base", "b").join(_side(edits, "local", "l"), keys, "full_outer").join(_side(edits, "remote", "r"), keys, "full_outer")
    return j.fillna(False, ["in_b", "in_l", "in_r"])


def three_way_merge(edits: DataFrame) -> DataFrame:
    """Per leaf: the same on both sides stays; unchanged here takes theirs; else ours. Absent is deleted."""
    s = snapshots(edits)
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y)) & (F.col(f"in_{x}") == F.col(f"in_{y}"))
    ours = same("l", "r") | ~same("l", "b")
    v, there = F.when(ours, F.col("l")).otherwise(F.col("r")), F.when(ours, F.col("in_l")).otherwise(F.col("in_r"))
    m = s.withColumn("v", v).withColumn("there", there)
    return m.where("there or in_l or in_r").select(
        "conv_id", "turn", "v", (~F.col("there")).alias("deleted"),
        (~(F.col("v").eqNullSafe(F.col("l")) & (F.col("there") == F.col("in_l")))).alias("differs_local"),
        (~(F.col("v").eqNullSafe(F.col("r")) & (F.col("there") == F.col("in_r")))).alias("differs_remote"),
    )


def additive_merge(edits: DataFrame) -> DataFrame:
    """Local markers and those remote ones that are neither in base nor local, by turn and text; local wins."""
    keys = ["conv_id", "turn", "v"]
    part = lambda n: edits.where(F.col("snapshot") == n).select(*keys).distinct()
    local, added = part("local"), part("remote").join(part("base"), keys, "left_anti").join(part("local"), keys, "left_anti")
    return local.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)))


def overlay(visible: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Visible rows, the first of each key, and the stored rows that no visible row hides. `visible` has `pos`."""
    first = visible.groupBy(*keys).agg(F.min_by("v", "pos").alias("v"))
    return first.unionByName(stored.select(*keys, "v").join(first, keys, "left_anti"))


def entry_changes(stored: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """What a store must put or delete to hold `merged`; empty values count as absent."""
    a = stored.where("v <> ''").select(*keys, F.col("v").alias("old"))
    b = merged.where("v <> ''").select(*keys, F.col("v").alias("new"))
    j = a.join(b, keys, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return j.select(*keys, F.when(F.col("new").isNull(), "delete").otherwise("put").alias("op"), "new")


def latest(items: DataFrame) -> DataFrame:
    """Per talk the newest item, then that of the highest number, and how many others there are."""
    top = F.max_by(F.struct("number", "status", "reviewer", "updated_at"), F.struct("updated_at", "number")).alias("t")
    return items.where("status is not null").groupBy("talk_id").agg(top, (F.count("*") - 1).alias("older")).select("talk_id", "t.*", "older")


def known_items(items: DataFrame, talks: DataFrame) -> DataFrame:
    return items.join(talks, "talk_id", "left_semi")


def title_to_talk(title):
    """The talk that a work item's title names, by the patterns of its kinds."""
    found = [F.regexp_extract(title, p, 1) for p in (r"^Review: ([0-9A-Za-z-]+)$", r"^Edit sync: ([0-9A-Za-z-]+) \(", r"([0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9A-Za-z-]+)")]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def work_rollup(items: DataFrame) -> DataFrame:
    """Talk to its items (number, state) in order, and how many are active."""
    named = items.withColumn("talk", title_to_talk(F.col("title"))).where("talk is not null")
    pairs = F.array_sort(F.collect_list(F.struct("number", "state")))
    return named.groupBy("talk").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["number"], F.lit(":"), x["state"])), " ").alias("items"), F.count_if(F.col("state").isin("open", "draft")).alias("active"))


def unique_slugs(rows: DataFrame, order: list[str]) -> DataFrame:
    """The second use of a slug becomes slug-2, the third slug-3."""
    n = F.row_number().over(Window.partitionBy("slug").orderBy(*order))
    return rows.withColumn("_n", n).withColumn("unique_slug", F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "_n"))).drop("_n")


def sessions(events: DataFrame, gap_s: int) -> DataFrame:
    """Bursts of a user's rows less than `gap_s` apart: how many, and the last value, as one flush after the burst."""
    bursts = events.groupBy("user_id", F.session_window("ts", f"{gap_s} seconds").alias("w"))
    return bursts.agg(F.count("*").alias("n"), F.max_by("v", F.struct("ts", "v")).alias("last")).select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("flush_ts"), "n", "last")


def render_outcomes(progress: DataFrame, limit_s: int, whole: float = 0.98) -> DataFrame:
    """What became of each render, from rows (render_id, ts, out_time, exit_code, total) up to its first exit.

    `stalled` where the greatest out_time stood for over `limit_s` from `at`, for `stalled_s` till it
    grew, the process ended or the rows do; at the exit `failed`, `truncated` (under `whole` of the
    total, or no progress) or `finished`.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    by_render, order = Window.partitionBy("render_id"), Window.partitionBy("render_id").orderBy("ts", F.col("exit_code").isNotNull(), "out_time")
    p = progress.withColumn("exits", F.sum(F.col("exit_code").isNotNull().cast("int")).over(order)).where("exits = 0 or (exits = 1 and exit_code is not null)")
    p = p.withColumn("best", F.max("out_time").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("first", F.row_number().over(order) == 1)
    p = p.withColumn("last_ts", F.max("ts").over(by_render)).withColumn("exit", F.col("exit_code").isNotNull())
    grown = p.where(~F.col("exit") & (F.col("first") | F.col("best").isNull() & F.col("out_time").isNotNull() | (F.col("out_time") > F.col("best"))))
    g = grown.withColumn("until", F.coalesce(F.lead("ts").over(order), "last_ts")).withColumn("us", us("until") - us("ts")).where(F.col("us") > limit_s * 1_000_000)
    stood = g.select("render_id", F.lit("stalled").alias("state"), F.col("ts").alias("at"), F.col("out_time").alias("best"), F.lit(None).cast("int").alias("exit_code"), F.expr("us div 1000000").alias("stalled_s"))
    state = F.when(F.col("exit_code") != 0, "failed").when(F.col("best").isNull() | (F.col("best") < whole * F.col("total")), "truncated").otherwise("finished")
    ended = p.where("exit").select("render_id", state.alias("state"), F.col("ts").alias("at"), "best", "exit_code", F.lit(None).cast("bigint").alias("stalled_s"))
    return stood.unionByName(ended)
