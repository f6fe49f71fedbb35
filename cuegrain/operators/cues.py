"""Measures, filters and timing repairs of cues. Each is one projection or one window over a video."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..staging import staged


@dataclass(frozen=True)
class Limits:
    """Thresholds of readable subtitles; times in milliseconds."""

    target_cps: int = 15
    hard_cps: int = 20
    cpl: int = 84
    chars: int = 84
    lines: int = 1
    min_duration: int = 1200
    max_duration: int = 21000
    min_gap: int = 80
    fps: int = 24
    sparse_cps: int = 2


LIMITS = Limits()


def video() -> WindowSpec:
    """A video in cue order."""
    return Window.partitionBy("video_id").orderBy("idx")


NO_TIME = 99900  # hundredths of characters a second of a cue that lasts no time


def chars(text: str = "text") -> Column:
    return F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))).cast("long")


def duration() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def cps100() -> Column:
    """Hundredths of characters a second, as an integer."""
    return F.when(duration() > 0, F.expr("cast(length(replace(text, '\n', '')) as bigint) * 100000 div (end_ms - start_ms)")).otherwise(NO_TIME)


def max_cpl() -> Column:
    return F.array_max(F.transform(F.split("text", "\n"), F.length))


def measures(cues: DataFrame) -> DataFrame:
    return cues.withColumns({"chars": chars(), "n_lines": F.size(F.split("text", "\n")), "max_cpl": max_cpl(), "dur_ms": duration(), "cps100": cps100()})


def flags(cues: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Over target or hard speed (by exact integers), too long lines, too short or long, too many lines or characters."""
    m = measures(cues)
    over = lambda cps: F.when(F.col("dur_ms") > 0, F.col("chars") * 1000 > cps * F.col("dur_ms")).otherwise(True)
    return m.withColumns({
        "over_target": over(limits.target_cps),
        "over_hard": over(limits.hard_cps),
        "over_cpl": F.col("max_cpl") > limits.cpl,
        "too_short": F.col("dur_ms") < limits.min_duration,
        "too_long": F.col("dur_ms") > limits.max_duration,
        "over_lines": F.col("n_lines") > limits.lines,
        "over_chars": F.col("chars") > limits.chars,
    })


def prev_end() -> Column:
    return F.lag("end_ms").over(video())


def next_start() -> Column:
    return F.lead("start_ms").over(video())


def with_gaps(cues: DataFrame) -> DataFrame:
    """gap_ms to the previous cue; null for the first."""
    return cues.withColumn("gap_ms", F.col("start_ms") - prev_end())


def gap_class(gap: Column, fps: int = LIMITS.fps) -> Column:
    """none, chain (3 to 11 frames) or large."""
    return F.when(gap < int(3000 / fps), "none").when(gap <= int(11000 / fps), "chain").otherwise("large")


def trim_overlaps(cues: DataFrame, gap: int = LIMITS.min_gap) -> DataFrame:
    """Ends move so that each gap is at least `gap`; starts stay, so one window is exact."""
    return cues.withColumn("end_ms", F.when(next_start() - F.col("end_ms") < gap, next_start() - gap).otherwise(F.col("end_ms")))


def structural_gap_fix(cues: DataFrame, gap: int = LIMITS.min_gap) -> DataFrame:
    """As trim_overlaps, but cues that touch exactly are left."""
    d = next_start() - F.col("end_ms")
    return cues.withColumn("end_ms", F.when((d < 0) | ((d > 0) & (d < gap)), next_start() - gap).otherwise(F.col("end_ms")))


def enforce_gaps(cues: DataFrame, gap: int = LIMITS.min_gap) -> DataFrame:
    """Trimmed ends with a class: ok, trimmed, large_overlap, or forced where a trim would leave nothing (end stays)."""
    d, to = next_start() - F.col("end_ms"), next_start() - gap
    kind = F.when(d.isNull() | (d >= gap), "ok").when(to <= F.col("start_ms"), "forced").when(d < -2000, "large_overlap").otherwise("trimmed")
    fixed = cues.withColumn("gap_class", kind).withColumn("_to", to)
    return fixed.withColumn("end_ms", F.when(F.col("gap_class").isin("trimmed", "large_overlap"), F.col("_to")).otherwise(F.col("end_ms"))).drop("_to")


def pad_into_silence(cues: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Ends grow into the pause after them, at most 5 s (2 s for the last cue) and the longest duration."""
    longest = F.col("start_ms") + limits.max_duration
    inner = F.greatest(F.col("end_ms"), F.least(next_start() - limits.min_gap, F.col("end_ms") + 5000, longest))
    last = F.greatest(F.col("end_ms"), F.least(F.col("end_ms") + 2000, longest))
    return cues.withColumn("end_ms", F.when(next_start().isNull(), last).otherwise(inner))


def chain_gaps(cues: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Gaps of 3 to 11 frames close to the least gap, unless the cue would grow past the longest by over a second."""
    d, to = next_start() - F.col("end_ms"), next_start() - limits.min_gap
    ok = (gap_class(d, limits.fps) == "chain") & (to - F.col("start_ms") <= limits.max_duration + 1000)
    return cues.withColumn("end_ms", F.when(ok, to).otherwise(F.col("end_ms")))


def cps_headroom(cues: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Time a dense cue needs for the target speed, what is free on either side, and whether that is enough."""
    wish = F.expr(f"cast(length(replace(text, '\n', '')) as bigint) * 1000 div {limits.target_cps}")
    need = F.greatest(F.lit(0), F.least(wish, F.greatest(duration(), F.lit(limits.max_duration))) - duration())
    right = F.greatest(F.lit(0), F.coalesce(next_start() - F.col("end_ms") - limits.min_gap, F.lit(2000)))
    left = F.greatest(F.lit(0), F.coalesce(F.col("start_ms") - prev_end() - limits.min_gap, F.col("start_ms")))
    out = cues.select("video_id", "idx", need.alias("need_ms"), left.alias("free_left"), right.alias("free_right"))
    verdict = F.when(F.col("need_ms") == 0, "ok").when(F.col("need_ms") <= F.col("free_right"), "right").when(F.col("need_ms") <= F.col("free_right") + F.col("free_left"), "both").otherwise("unfixable")
    return out.withColumn("verdict", verdict)


def neighbour_slack(cues: DataFrame, reach: int = 10, limits: Limits = LIMITS) -> DataFrame:
    """Spare gap within `reach` cues each side, with whether a short or dense cue could be fixed from it."""
    m = flags(with_gaps(cues), limits).withColumn("spare", F.greatest(F.lit(0), F.col("gap_ms") - limits.min_gap))
    ahead = F.coalesce(F.sum("spare").over(video().rowsBetween(1, reach)), F.lit(0))
    behind = F.coalesce(F.sum("spare").over(video().rowsBetween(-reach + 1, 0)), F.lit(0)) + F.when(F.row_number().over(video()) <= reach, F.first("start_ms").over(video())).otherwise(0)
    want = F.greatest(F.lit(0), limits.min_duration - F.col("dur_ms"), F.expr(f"chars * 1000 div {limits.hard_cps}") - F.col("dur_ms"))
    out = m.select("video_id", "idx", want.alias("want_ms"), behind.alias("slack_left"), ahead.alias("slack_right"))
    return out.withColumn("fixable", F.col("want_ms") <= F.col("slack_left") + F.col("slack_right"))


def donor_capacity(cues: DataFrame, reach: int = 8, limits: Limits = LIMITS) -> DataFrame:
    """Time that neighbours could give and still stay under the target speed, or under 95% of the hard one."""
    m = measures(cues)
    out = m
    for name, level in (("target", limits.target_cps * 100), ("hard", limits.hard_cps * 95)):
        gift = F.greatest(F.lit(0), F.col("dur_ms") - F.expr(f"chars * 100000 div {level}") - limits.min_gap)
        out = out.withColumn(f"_{name}", F.when(gift > 30, gift).otherwise(0))
    side = lambda c, a, b: F.coalesce(F.sum(c).over(video().rowsBetween(a, b)), F.lit(0))
    return out.select("video_id", "idx", *[side(f"_{n}", a, b).alias(f"{n}_{s}") for n in ("target", "hard") for s, a, b in (("left", -reach, -1), ("right", 1, reach))])


def gap_budget(cues: DataFrame, reach: int = 10, limits: Limits = LIMITS) -> DataFrame:
    """For cues over the target speed, the usable part of gaps over 200 ms near them."""
    m = flags(with_gaps(cues), limits).withColumn("usable", F.when(F.col("gap_ms") > 200, F.col("gap_ms") - limits.min_gap).otherwise(0))
    ahead = F.coalesce(F.sum("usable").over(video().rowsBetween(1, reach)), F.lit(0))
    behind = F.coalesce(F.sum("usable").over(video().rowsBetween(-reach + 1, 0)), F.lit(0))
    out = m.select("video_id", "idx", "over_target", behind.alias("budget_left"), ahead.alias("budget_right"))
    return out.where("over_target").drop("over_target")


def pause_paragraphs(cues: DataFrame, pause: int = 2000) -> DataFrame:
    """A new paragraph where the gap is longer than `pause`; numbered from 0."""
    new = F.coalesce((F.col("start_ms") - prev_end() > pause).cast("int"), F.lit(0))
    return cues.withColumn("_new", new).withColumn("paragraph", F.sum("_new").over(video())).drop("_new")


def _merge_pass(cues: DataFrame, limits: Limits, silence: int) -> DataFrame:
    """One greedy pass over cues with `parts`; see merge_short_pairs."""
    m = measures(cues)
    nxt = lambda c: F.lead(c).over(video())
    weak = (F.col("dur_ms") < limits.min_duration) | (nxt("dur_ms") < limits.min_duration) | (F.col("chars") * 1000 < limits.sparse_cps * F.col("dur_ms")) | (nxt("chars") * 1000 < limits.sparse_cps * nxt("dur_ms"))
    fits = (F.col("chars") + 1 + nxt("chars") <= limits.chars) & (nxt("end_ms") - F.col("start_ms") <= limits.max_duration) & (nxt("start_ms") - F.col("end_ms") < silence)
    m = m.withColumn("ok", F.coalesce(weak & fits, F.lit(False)))
    m = m.withColumn("run", F.row_number().over(video()) - F.row_number().over(Window.partitionBy("video_id", "ok").orderBy("idx")))
    place = F.row_number().over(Window.partitionBy("video_id", "ok", "run").orderBy("idx"))
    m = m.withColumn("head", F.col("ok") & (place % 2 == 1)).withColumn("tail", F.coalesce(F.lag("head").over(video()), F.lit(False)))
    joined = lambda c, made: F.when(F.col("head"), made).otherwise(F.col(c))
    merged = m.select("video_id", "idx", "start_ms", joined("end_ms", nxt("end_ms")).alias("end_ms"), joined("text", F.concat_ws(" ", "text", nxt("text"))).alias("text"), joined("parts", F.col("parts") + nxt("parts")).alias("parts"), "head", "tail").where(~F.col("tail"))
    return merged.select("video_id", F.row_number().over(video()).alias("idx"), "start_ms", "end_ms", "text", "parts", F.col("head").alias("merged"))


def merge_short_pairs(cues: DataFrame, limits: Limits = LIMITS, silence: int = 500) -> DataFrame:
    """One pass of merging neighbours of which one is short or sparse: greedy from the left, so every
    other pair of each unbroken run of eligible cues. Cues are numbered anew."""
    return _merge_pass(cues.withColumn("parts", F.lit(1)), limits, silence).drop("parts")


def merge_short(cues: DataFrame, limits: Limits = LIMITS, silence: int = 500, passes: int = 5) -> DataFrame:
    """Passes of merge_short_pairs until no pair is eligible, at most `passes`: video_id, idx, times, text and `parts`, the cues in each.

    Each pass is written, so the next one starts from its rows. Only videos in which the last pass
    merged something take part in the next.
    """
    open_ = cues.select("video_id", "idx", "start_ms", "end_ms", "text").withColumn("parts", F.lit(1).cast("long"))
    done = None
    for n in range(passes):
        made = staged(_merge_pass(open_, limits, silence).withColumn("_on", F.max("merged").over(Window.partitionBy("video_id"))), f"merged-{n}")
        rest = made.where("not _on").drop("merged", "_on")
        done = rest if done is None else done.unionByName(rest)
        open_ = made.where("_on").drop("merged", "_on")
        if open_.isEmpty():
            return done
    return done.unionByName(open_)


def sparse_merge_forward(cues: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Cues that are sparse and under 20 characters, with whether they can join the next one (pause up to 3 s)."""
    m = measures(cues)
    nxt = lambda c: F.lead(c).over(video())
    can = (nxt("start_ms") - F.col("end_ms") <= 3000) & (F.col("chars") + 1 + nxt("chars") <= limits.chars) & (nxt("end_ms") - F.col("start_ms") <= limits.max_duration)
    sparse = (F.col("chars") < 20) & (F.col("dur_ms") > 0) & (F.col("chars") * 1000 < limits.sparse_cps * F.col("dur_ms"))
    return m.withColumn("can", F.coalesce(can, F.lit(False))).where(sparse).select("video_id", "idx", "chars", "dur_ms", "can")


def share_pauses(cues: DataFrame, want: int = 300, limits: Limits = LIMITS) -> DataFrame:
    """The pause between neighbours is shared: the next cue starts earlier by what it wants, the one before ends later by the rest.

    Both sides want the time that a cue lacks for the target speed, at most `want`. A cue's wish for
    its end is less what its start gained.
    """
    lack = F.greatest(F.lit(0), F.least(F.lit(want), F.expr(f"chars * 1000 div {limits.target_cps}") - F.col("dur_ms")))
    m = measures(cues).withColumn("lack", lack).withColumn("free", F.greatest(F.lit(0), F.col("start_ms") - prev_end() - limits.min_gap))
    m = m.withColumn("early", F.coalesce(F.least("lack", "free"), F.lit(0)))
    left = F.lead(F.col("free") - F.col("early")).over(video())
    late = F.when(left.isNull(), 0).otherwise(F.least(F.col("lack") - F.col("early"), left))
    return m.withColumn("late", late).select("video_id", "idx", (F.col("start_ms") - F.col("early")).alias("start_ms"), (F.col("end_ms") + F.col("late")).alias("end_ms"), "early", "late")


def snap_trim(cues: DataFrame, gap: int = LIMITS.min_gap) -> DataFrame:
    end = F.greatest("start_ms", F.least(F.col("end_ms"), next_start() - gap))
    return cues.withColumn("end_ms", F.when(next_start() - F.col("end_ms") < gap, end).otherwise(F.col("end_ms")))


def min_duration_floor(cues: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Short cues grow into the pause after them, up to the least duration."""
    room = F.greatest(F.col("end_ms"), F.coalesce(next_start() - limits.min_gap, F.col("start_ms") + limits.min_duration))
    return cues.withColumn("end_ms", F.when(duration() < limits.min_duration, F.greatest(F.col("end_ms"), F.least(F.col("start_ms") + limits.min_duration, room))).otherwise(F.col("end_ms")))


def fix_structural_text(cues: DataFrame) -> DataFrame:
    """Double spaces collapse and lines are trimmed, with whether either changed the text."""
    single = F.regexp_replace("text", " {2,}", " ")
    trimmed = F.array_join(F.transform(F.split(single, "\n"), lambda x: F.trim(x)), "\n")
    return cues.select("video_id", "idx", trimmed.alias("text"), (single != F.col("text")).alias("spaces_fixed"), (trimmed != single).alias("lines_trimmed"))


def join_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    joined = F.regexp_replace(text, r"\s*\n\s*", " ")
    return rows.withColumn("changed", joined != F.col(text)).withColumn(text, joined)


def shift_timeline(cues: DataFrame, offsets: DataFrame) -> DataFrame:
    """Times moved by each video's offset_ms; cues that would end at or before 0 go, starts stop at 0, cues are numbered anew."""
    moved = cues.join(offsets, "video_id").select("video_id", "idx", "text", (F.col("start_ms") + F.col("offset_ms")).alias("start_ms"), (F.col("end_ms") + F.col("offset_ms")).alias("end_ms"))
    kept = moved.where("end_ms > 0").withColumn("start_ms", F.greatest(F.lit(0), "start_ms"))
    return kept.withColumn("idx", F.row_number().over(video()))


def drop_hallucinations(segments: DataFrame, text: str = "text") -> DataFrame:
    """Segments that are empty or only dots, ellipses and spaces go; ids start anew from 0."""
    kept = segments.where(~F.col(text).rlike("^[.… ]*$"))
    return kept.withColumn("seg_id", F.row_number().over(Window.partitionBy("video_id").orderBy("seg_id")) - 1)


def drop_stage_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.where(~F.col(text).rlike(r"^\[[^\[\]]+\]$"))


def range_select(cues: DataFrame, first: int, last: int) -> DataFrame:
    """Cues with idx in the range, which is clamped to what a video has."""
    return cues.where(F.col("idx").between(max(1, first), last))


def text_search(cues: DataFrame, needle: str) -> DataFrame:
    return cues.where(F.contains(F.lower("text"), F.lit(needle.lower())))
