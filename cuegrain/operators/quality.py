"""Per-video aggregates, reports and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ms_to_timecode
from .cues import LIMITS, Limits, flags, video, with_gaps


def video_stats(cues: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row a video: counts of every flag, overlaps and tight gaps, speed and width in hundredths. Upper median."""
    # measured before the window, whose shuffle then has no text
    m = with_gaps(flags(cues, limits))
    n = F.count("*")
    return m.groupBy("video_id").agg(
        n.alias("blocks"),
        F.sum("chars").cast("long").alias("chars"),
        F.count_if("over_target").alias("over_target"),
        F.count_if("over_hard").alias("over_hard"),
        F.count_if("over_cpl").alias("over_cpl"),
        F.count_if("too_short").alias("short"),
        F.count_if("too_long").alias("long"),
        F.count_if(F.col("gap_ms") < 0).alias("overlaps"),
        F.count_if((F.col("gap_ms") >= 0) & (F.col("gap_ms") < limits.min_gap)).alias("tight_gaps"),
        F.expr("sum(cps100) div count(*)").alias("avg_cps100"),
        F.max("cps100").alias("max_cps100"),
        F.max("max_cpl").alias("max_cpl"),
        F.expr("sum(max_cpl) * 100 div count(*)").alias("avg_cpl100"),
        F.expr("element_at(sort_array(collect_list(cps100)), cast(count(*) div 2 + 1 as int))").alias("median_cps100"),
    )


METRICS = ("blocks", "over_target", "over_hard", "over_cpl", "short", "long", "overlaps", "tight_gaps", "avg_cps100", "max_cps100", "median_cps100", "max_cpl")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Twelve metrics of two versions with the signed change, one row each."""
    b, a = video_stats(before), video_stats(after)
    joined = b.select("video_id", *[F.col(m).alias(f"b_{m}") for m in METRICS]).join(a.select("video_id", *[F.col(m).alias(f"a_{m}") for m in METRICS]), "video_id")
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").cast("long").alias("before"), F.col(f"a_{m}").cast("long").alias("after")) for m in METRICS]))
    return joined.select("video_id", long.alias("x")).select("video_id", "x.metric", "x.before", "x.after", (F.col("x.after") - F.col("x.before")).alias("change"))


def overlap_report(cues: DataFrame, most: int = 10) -> DataFrame:
    """The first overlapping pairs of each video, with the number of all."""
    pairs = cues.select("video_id", F.lag("idx").over(video()).alias("prev_idx"), "idx", (F.lag("end_ms").over(video()) - F.col("start_ms")).alias("overlap_ms")).where("overlap_ms > 0")
    return first_violations(pairs, most, "overlaps")


def first_violations(rows: DataFrame, most: int, total: str = "total") -> DataFrame:
    """The first rows of each video and how many there are in all."""
    counted = rows.withColumn("_n", F.row_number().over(video())).withColumn(total, F.count("*").over(Window.partitionBy("video_id")))
    return counted.where(F.col("_n") <= most).drop("_n")


def numbering_check(cues: DataFrame) -> DataFrame:
    placed = cues.select("video_id", (F.col("idx") != F.row_number().over(video())).alias("wrong"))
    return placed.groupBy("video_id").agg(F.count_if("wrong").alias("misnumbered"))


def baseline_drift(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Names of the measures that left their tolerance around a stored baseline."""
    cols = ("blocks", "avg_cps100", "over_hard", "short")
    j = now.select("video_id", *cols).join(baseline.select("video_id", *[F.col(c).alias(f"b_{c}") for c in cols]), "video_id")
    far = lambda c, least, rate: F.col(c) > F.greatest(F.lit(least), F.floor(F.col(f"b_{c}") * rate + least))
    drift = [
        F.when(F.abs(F.col("blocks") - F.col("b_blocks")) > F.greatest(F.lit(3), F.floor(F.col("b_blocks") * 0.02)), "blocks"),
        F.when(F.abs(F.col("avg_cps100") - F.col("b_avg_cps100")) > 100, "avg_cps"),
        F.when(far("over_hard", 2, 1.5), "outliers"),
        F.when(far("short", 5, 1.5), "short"),
    ]
    return j.select("video_id", F.array_compact(F.array(*drift)).alias("drift"))


def corpus_info(cues: DataFrame) -> DataFrame:
    return cues.groupBy("video_id").agg(F.count("*").alias("cues"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.sum(F.size(F.split("text", " "))).alias("words"))


def glyph_coverage(cues: DataFrame) -> DataFrame:
    """Distinct characters of a video but white space, in code-point order."""
    glyphs = cues.select("video_id", F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"\s", ""), ""))).alias("g")).where("g <> ''")
    return glyphs.groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_set("g")), "").alias("glyphs"))


def stats_report(stats: DataFrame) -> DataFrame:
    """Shares of a video's cues in parts per thousand."""
    return stats.select("video_id", "blocks", *[F.expr(f"{c} * 1000 div blocks").alias(f"{c}_pm") for c in ("over_target", "over_hard", "over_cpl", "short")])


def worst_cps(cues: DataFrame, most: int = 10) -> DataFrame:
    m = flags(cues)
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("cps100"), "idx"))
    excerpt = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("..."))).otherwise(F.col("text"))
    return m.withColumn("rank", rank).where(F.col("rank") <= most).select("video_id", "idx", "cps100", excerpt.alias("excerpt"), "rank")


def _ordered(df: DataFrame, by: str, text, sep: str, out: str = "file"):
    parts = F.array_sort(F.collect_list(F.struct(F.col(by), text.alias("t"))))
    return df.groupBy("video_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(out))


def cue_files(cues: DataFrame) -> DataFrame:
    """The text of each video's cue file, cues numbered from 1."""
    n = cues.withColumn("n", F.row_number().over(video()))
    text = F.concat(F.col("n"), F.lit("\n"), ms_to_timecode(F.col("start_ms")), F.lit(" --> "), ms_to_timecode(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    return _ordered(n, "n", text, "")


def paragraph_files(cues: DataFrame) -> DataFrame:
    """Header and paragraphs; `cues` has paragraph numbers."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    paras = cues.groupBy("video_id", "paragraph").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("p"))
    files = _ordered(paras, "paragraph", F.col("p"), "\n\n", "body")
    return files.select("video_id", F.concat(F.lit("Video "), F.col("video_id"), F.lit("\n\n"), F.col("body")).alias("file"))


def review_files(cues: DataFrame) -> DataFrame:
    return _ordered(cues, "idx", F.concat(F.lit("["), F.col("idx"), F.lit("] "), F.replace("text", F.lit("\n"), F.lit(" "))), "\n")
