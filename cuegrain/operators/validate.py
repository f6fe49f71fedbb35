"""Contracts and verdicts over whole corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import video_stats

BEFORE_MS, AFTER_MS = 60_000, 5_000


def flags_of(manifests: DataFrame, videos: DataFrame) -> DataFrame:
    """Checks that each video's build mode leaves out; strict without a manifest."""
    j = videos.select("video_id").distinct().join(manifests, "video_id", "left")
    second = F.coalesce(F.col("role") == "secondary", F.lit(False))
    source = F.coalesce((F.col("role") == "primary") & (F.col("mode") == "en-srt"), F.lit(False))
    return j.select("video_id", (second | source).alias("skip_text"), second.alias("skip_time"), second.alias("skip_cps"), F.col("role").isNotNull().alias("skip_duration"), source.alias("compare_blocks"))


def time_range(cues: DataFrame, anchors: DataFrame) -> DataFrame:
    """Whether first start and last end stay within the anchor's range, with tolerance."""
    c = cues.groupBy("video_id").agg(F.min_by("start_ms", "idx").alias("first_ms"), F.max_by("end_ms", "idx").alias("last_ms"))
    a = anchors.groupBy("video_id").agg(F.min("start_ms").alias("from_ms"), F.max("end_ms").alias("to_ms"))
    j = c.join(a, "video_id")
    return j.withColumn("before", F.col("first_ms") < F.col("from_ms") - BEFORE_MS).withColumn("after", F.col("last_ms") > F.col("to_ms") + AFTER_MS)


def block_ratio(cues: DataFrame, others: DataFrame) -> DataFrame:
    """Cue counts in two versions; failed above twice, skipped if the other has none."""
    a = cues.groupBy("video_id").agg(F.count("*").alias("blocks"))
    b = others.groupBy("video_id").agg(F.count("*").alias("other_blocks"))
    j = a.join(b, "video_id", "left").fillna(0, ["other_blocks"])
    return j.withColumn("verdict", F.when(F.col("other_blocks") == 0, "skip").when(F.col("blocks") > 2 * F.col("other_blocks"), "fail").otherwise("ok"))


def validate(cues: DataFrame, text: DataFrame, anchors: DataFrame, others: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row a video with a boolean for each check and the verdict; checks that the mode skips pass.

    `text` has video_id and equal, from text_preservation.
    """
    stats = video_stats(cues).select("video_id", "blocks", "over_hard", "over_cpl", "short", "long", "overlaps", "tight_gaps")
    order = Window.partitionBy("video_id").orderBy("idx")
    numbers = cues.select("video_id", (F.col("idx") != F.row_number().over(order)).alias("w")).groupBy("video_id").agg(F.count_if("w").alias("wrong"))
    j = stats.join(flags_of(manifests, cues), "video_id").join(numbers, "video_id").join(text.select("video_id", "equal"), "video_id", "left")
    j = j.join(time_range(cues, anchors).select("video_id", "before", "after"), "video_id", "left").join(block_ratio(cues, others).select("video_id", F.col("verdict").alias("ratio")), "video_id", "left")
    checks = {
        "text": F.col("skip_text") | F.coalesce("equal", F.lit(False)),
        "overlap": F.col("overlaps") == 0,
        "time": F.col("skip_time") | ~(F.coalesce("before", F.lit(False)) | F.coalesce("after", F.lit(False))),
        "numbering": F.col("wrong") == 0,
        "cpl": F.col("over_cpl") == 0,
        "gap": F.col("tight_gaps") == 0,
        "block_ratio": ~F.col("compare_blocks") | (F.col("ratio") != "fail"),
        "duration": F.col("skip_duration") | (F.col("short") + F.col("long") == 0),
        "cps": F.col("skip_cps") | (F.col("over_hard") == 0),
    }
    out = j.select("video_id", "blocks", *[c.alias(n) for n, c in checks.items()])
    return out.withColumn("passed", reduce(lambda a, b: a & b, [F.col(n) for n in checks]))


CHECKS = ("text", "overlap", "time", "numbering", "cpl", "gap", "block_ratio", "duration", "cps")


def report_rows(verdicts: DataFrame) -> DataFrame:
    """One row for each video and check."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.when(F.col(c), "PASS").otherwise("FAIL").alias("result")) for c in CHECKS]))
    return verdicts.select("video_id", rows.alias("x")).select("video_id", "x.check", "x.result")


def missing_ids(blocks: DataFrame, timecodes: DataFrame) -> DataFrame:
    """Ids of blocks without a timecode: video_id, idx. Both have `ids`, in one row a video; each missing id comes once, whatever the order."""
    asked = blocks.select("video_id", "ids", F.array().cast("array<int>").alias("known"))
    both = asked.unionByName(timecodes.select("video_id", F.array().cast("array<int>").alias("ids"), F.col("ids").alias("known")))
    rows = both.groupBy("video_id").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("known")).alias("known"))
    return rows.select("video_id", F.explode_outer(F.array_except("ids", "known")).alias("idx")).where("idx is not null")


def speech_contract(segments: DataFrame, rewind_ms: int = 20_000) -> DataFrame:
    """Violations of recognised speech: negative start, end before start, a start far behind what was reached."""
    order = Window.partitionBy("video_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("reached", F.max("end_ms").over(order))
    rules = {"negative start": F.col("start_ms") < 0, "end before start": F.col("end_ms") < F.col("start_ms"), "rewind": F.col("reached") - F.col("start_ms") > rewind_ms}
    found = F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))
    return s.select("video_id", "seg_id", found.alias("violation"))


def timecode_contract(timecodes: DataFrame) -> DataFrame:
    """Violations of written timecodes: duplicate id, ids with a hole, starts that go back, no length."""
    order = Window.partitionBy("video_id").orderBy("id")
    t = timecodes.withColumn("n", F.count("*").over(Window.partitionBy("video_id", "id"))).withColumn("pi", F.lag("id").over(order)).withColumn("ps", F.lag("start_ms").over(order))
    rules = {"duplicate": F.col("n") > 1, "hole": F.col("id") - F.col("pi") > 1, "not ascending": F.col("start_ms") < F.col("ps"), "no length": F.col("start_ms") >= F.col("end_ms")}
    found = F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))
    return t.select("video_id", "id", found.alias("violation"))
