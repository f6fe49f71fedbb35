"""Joins of timed rows: intervals, as-of, positions, shared word runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_word
from . import packed as P
from .cues import cps100, duration


#: The most buckets that a row is dealt into.
MOST_BUCKETS = 1000


def interval_join(left: DataFrame, right: DataFrame, closed: bool = False, bucket_ms: int = 10_000, how: str = "inner") -> DataFrame:
    """Rows of one video whose [start_ms, end_ms] overlap; `right` has r_start, r_end and its own columns.

    Both sides are dealt into time buckets, so the range join is an equi join on (video, bucket); a
    pair that shares several buckets is kept in the first of them only. Rows over MOST_BUCKETS long,
    such as one corrupt end time makes, are split off and not dealt: they meet the rows of their
    video by an equi join on the video alone, which the short rows of other videos do not enter.
    """
    first, last = lambda a: F.floor(F.col(a) / bucket_ms), lambda a, z: F.floor(F.greatest(F.col(a), F.col(z)) / bucket_ms)
    long_ = lambda a, z: F.coalesce(last(a, z) - first(a) >= MOST_BUCKETS, F.lit(False))
    meet = (F.col("r_end") >= F.col("start_ms")) & (F.col("r_start") <= F.col("end_ms")) if closed else (F.col("start_ms") < F.col("r_end")) & (F.col("end_ms") > F.col("r_start"))
    long_left, long_right = long_("start_ms", "end_ms"), long_("r_start", "r_end")
    a = left.where(~long_left).withColumn("_b", F.explode(F.sequence(first("start_ms"), last("start_ms", "end_ms"))))
    b = right.where(~long_right).withColumn("_b", F.explode(F.sequence(first("r_start"), last("r_start", "r_end"))))
    short = a.join(b, ["video_id", "_b"]).where(meet & (F.col("_b") == F.floor(F.greatest("start_ms", "r_start") / bucket_ms))).drop("_b")
    # few rows if any: the other side is only read for their videos
    apart = left.where(long_left).join(right, "video_id").unionByName(left.where(~long_left).join(right.where(long_right), "video_id"))
    pairs = short.unionByName(apart.where(meet))
    if how == "inner":
        return pairs
    keys = ["video_id", "idx"]
    return left.join(pairs.select(*keys, *[c for c in right.columns if c != "video_id"]), keys, "left")


def as_right(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("video_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), *columns)


def _heard(spans: DataFrame, words: DataFrame) -> DataFrame:
    """One row a video of `spans`: them as `spans`, sorted by idx, and its words as `heard`. Words are rows, or in one row a video already, as from views.spoken."""
    heard = words if "heard" in words.columns else P.in_rows(words, "heard", "start_ms", "end_ms")
    return P.in_rows(spans, "spans", "idx", "start_ms", "end_ms").join(heard.select("video_id", P.times(F.col("heard")).alias("heard")), "video_id", "left")


def _each(rows: DataFrame, found: Column) -> DataFrame:
    """`spans` of `rows` as rows (video_id, idx, start_ms, end_ms, x), x by an array `found` in their order."""
    return rows.select("video_id", F.explode_outer(F.arrays_zip("spans", found.alias("x"))).alias("y")).select("video_id", "y.spans.*", "y.x")


def speech_span(cues: DataFrame, words: DataFrame) -> DataFrame:
    """First word start and last word end that touch each cue; the cue's own times where no word does. Words are rows, or `heard` in one row a video."""
    near = _each(_heard(cues, words), P.touching(P.times(F.col("spans")), F.col("heard"), closed=True))
    return near.select("video_id", "idx", F.coalesce("x.first", "start_ms").alias("speech_start"), F.coalesce("x.last", "end_ms").alias("speech_end"), F.col("x.n").alias("n_words"))


def _near(cues: DataFrame, segments: DataFrame, edge: str, reach: int) -> DataFrame:
    """For each cue the first segment in file order whose `edge` is within reach of the cue's."""
    points = cues.select("video_id", "idx", (F.col(edge) - reach).alias("start_ms"), (F.col(edge) + reach).alias("end_ms"), F.col(edge).alias("at"))
    marks = segments.select("video_id", F.col(edge).alias("r_start"), F.col(edge).alias("r_end"), "seg_id")
    hit = interval_join(points, marks, closed=True)
    return hit.groupBy("video_id", "idx", "at").agg(F.min_by("r_start", "seg_id").alias("seg_at"))


def early_late(cues: DataFrame, segments: DataFrame, reach: int = 3000, early: int = 500, late: int = 2000) -> DataFrame:
    """Per video the cues that start well before, or end well after, the speech nearest them."""
    starts = _near(cues, segments, "start_ms", reach).groupBy("video_id").agg(F.count_if(F.col("at") < F.col("seg_at") - early).alias("early"))
    ends = _near(cues, segments, "end_ms", reach).groupBy("video_id").agg(F.count_if(F.col("at") > F.col("seg_at") + late).alias("late"))
    videos = cues.groupBy("video_id").agg(F.count("*").alias("cues"))
    joined = videos.join(starts, "video_id", "left").join(ends, "video_id", "left")
    return joined.select("video_id", "cues", F.coalesce("early", F.lit(0)).alias("early"), F.coalesce("late", F.lit(0)).alias("late"))


def best_overlap(cues: DataFrame, segments: DataFrame, longest: int = 7000, sparse_cps100: int = 2600, least_saving: int = 2000) -> DataFrame:
    """The segment that overlaps each cue most, the first at a tie; what a trim of long sparse cues to it would save."""
    pairs = interval_join(cues.select("video_id", "idx", "text", "start_ms", "end_ms"), as_right(segments, "seg_id"))
    overlap = F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start")
    pairs = pairs.withColumn("o", F.struct(overlap.alias("overlap_ms"), (-F.col("seg_id")).alias("neg")))
    best = pairs.groupBy("video_id", "idx", "text", "start_ms", "end_ms").agg(F.max("o").alias("o"))
    saved = duration() - F.col("o.overlap_ms")
    trim = F.when((duration() > longest) & (cps100() < sparse_cps100) & (saved >= least_saving), saved).otherwise(0)
    return best.select("video_id", "idx", (-F.col("o.neg")).alias("seg_id"), "o.overlap_ms", trim.alias("trim_ms"))


def active_cue(cues: DataFrame, points: DataFrame) -> DataFrame:
    """The first cue with start <= t < end for each point (video_id, t)."""
    marks = points.select("video_id", F.col("t").alias("r_start"), F.col("t").alias("r_end"))
    hit = interval_join(cues.select("video_id", "idx", "start_ms", "end_ms"), marks, closed=True).where(F.col("r_start") < F.col("end_ms"))
    return hit.groupBy("video_id", F.col("r_start").alias("t")).agg(F.min("idx").alias("idx"))


def word_stream(cues: DataFrame) -> DataFrame:
    """Normalised words of a video in order, timed by their place in the cue."""
    w = cues.select("video_id", "idx", "start_ms", "end_ms", F.size(F.split("text", " ")).alias("n"), F.posexplode(F.split("text", " ")).alias("p", "word"))
    t = F.expr("start_ms + (p * (end_ms - start_ms)) div n")
    return w.select("video_id", "idx", "p", norm_word(F.col("word")).alias("w"), t.alias("t")).where("w <> ''")


def monotone(anchors: DataFrame) -> DataFrame:
    """Anchors (video_id, p, s) in order of p whose s is no less than that of every one kept before: a running maximum."""
    order = Window.partitionBy("video_id").orderBy("p", "s").rowsBetween(Window.unboundedPreceding, -1)
    return anchors.withColumn("_m", F.max("s").over(order)).where("_m is null or s >= _m").drop("_m")


def anchored(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """One row a video that both have: the primary's cues, `anchors` (a, b), times of the primary and the secondary in order, and the `places` among them of the cues' starts and ends."""
    x, y = P.in_rows(primary, "cues", "idx", "start_ms", "end_ms", "text"), P.in_rows(secondary, "others", "idx", "start_ms", "end_ms", "text")
    said = lambda c: P.stream(F.col(c), P.word_time)
    both = x.join(y, "video_id").select("video_id", "cues", P.shared_triples(said("cues"), said("others")).alias("anchors"))
    return P.rising(both.withColumn("anchors", P.first_of_each(F.col("anchors"))), "anchors", strict=False, points=_ends())


def _ends() -> Column:
    return F.flatten(F.transform("cues", lambda c: F.array(c["start_ms"], c["end_ms"])))


def anchor_map(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Times at which two recordings say the same three words that each says once: the longest run of them that rises in both."""
    found = anchored(primary, secondary).select("video_id", F.explode_outer("anchors").alias("x")).where("x is not null")
    return found.select("video_id", F.col("x.a").alias("p"), F.col("x.b").alias("s"))


def _mapped(rows: DataFrame, points: Column, reach: int) -> DataFrame:
    """`rows` with `mapped`: the array `points`, whose `places` among the `anchors` (a, b) are known, on the other timeline; see remap."""
    def found(t: Column, k: Column, anchors: Column) -> Column:
        trunc = lambda x: x.cast("bigint")
        ratio = lambda a, b: (b["b"] - a["b"]) / (b["a"] - a["a"])
        n = F.size(anchors)
        lo, hi, a1, a2, z1, z2 = (F.get(anchors, i) for i in (k - 1, k, F.lit(0), F.lit(1), n - 1, n - 2))
        before = F.when(a1["a"] - t <= reach, F.greatest(F.lit(0), F.when(a2.isNull(), a1["b"] - (a1["a"] - t)).otherwise(trunc(a1["b"] - ratio(a1, a2) * (a1["a"] - t)))))
        after = F.when(t - z1["a"] <= reach, F.when(z2.isNull(), z1["b"] + (t - z1["a"])).otherwise(trunc(z1["b"] + ratio(z2, z1) * (t - z1["a"]))))
        inner = trunc(lo["b"] + (t - lo["a"]) / (hi["a"] - lo["a"]) * (hi["b"] - lo["b"]))
        return F.when(t < a1["a"], before).when(t > z1["a"], after).when(t == a1["a"], a1["b"]).otherwise(inner)

    known = F.struct(points.alias("t"), "places", "anchors")
    return rows.withColumn("mapped", P.let(known, lambda r: F.transform(r["t"], lambda t, i: found(t, F.get(r["places"], i), r["anchors"]))))


def remap(points: DataFrame, anchors: DataFrame, reach: int = 2000) -> DataFrame:
    """`points` (video_id, id, t) on the secondary timeline: between the anchors before and after by proportion,
    up to `reach` outside them by the slope of the outermost pair (not below 0 before the first); else null."""
    marks = P.in_rows(anchors.select("video_id", F.col("p").alias("a"), F.col("s").alias("b")), "anchors", "a", "b")
    times = F.transform("points", lambda x: x["t"])
    both = P.in_rows(points, "points", "t", "id").join(marks, "video_id")
    rows = _mapped(both.withColumn("places", P.places(times, F.transform("anchors", lambda x: x["a"]))), times, reach)
    found = P.let(F.struct("points", "mapped"), lambda r: F.transform(r["points"], lambda x, i: F.struct(x["id"].alias("id"), x["t"].alias("t"), F.get(r["mapped"], i).alias("mapped"))))
    each = rows.select("video_id", F.explode_outer(found).alias("x"))
    return each.select("video_id", "x.*")


def remap_cues(rows: DataFrame, reach: int = 2000) -> DataFrame:
    """The cues of `anchored` rows on the other timeline; those with an end that cannot be placed go; an end not after its start is 1 ms after."""
    placed = _mapped(rows, _ends(), reach)
    found = P.let(F.struct("cues", "mapped"), lambda r: F.transform(r["cues"], lambda c, i: F.struct(c["idx"].alias("idx"), c["text"].alias("text"), F.get(r["mapped"], i * 2).alias("a"), F.get(r["mapped"], i * 2 + 1).alias("z"))))
    times = placed.select("video_id", F.explode_outer(found).alias("x")).select("video_id", "x.*").where("a is not null and z is not null")
    return times.select("video_id", "idx", F.col("a").alias("start_ms"), F.when(F.col("z") <= F.col("a"), F.col("a") + 1).otherwise(F.col("z")).alias("end_ms"), "text")


def assemble(blocks: DataFrame, timecodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (video_id, idx, text) with times, and problems: ids without a time, times that do not rise."""
    t = timecodes.withColumnRenamed("id", "idx")
    good = blocks.join(t.where("start_ms < end_ms"), ["video_id", "idx"])
    missing = blocks.join(t, ["video_id", "idx"], "left_anti").select("video_id", "idx", F.lit("missing").alias("problem"))
    flat = t.where("start_ms >= end_ms").join(blocks.select("video_id", "idx"), ["video_id", "idx"]).select("video_id", "idx", F.lit("no length").alias("problem"))
    return good, missing.unionByName(flat)


def text_preservation(source: DataFrame, made: DataFrame, source_order: str = "para_idx", made_order: str = "idx") -> DataFrame:
    """The words of each video's rows in order compared place by place, whatever their case: counts, first difference and its kind.

    Words are cut at blanks, tabs and line ends. The texts of both sides meet in one row a video, by one shuffle.
    """
    part = lambda df, side, order: df.select("video_id", F.lit(side).alias("side"), F.col(order).cast("long").alias("at"), "text")
    rows = P.in_rows(part(source, 0, source_order).unionByName(part(made, 1, made_order)), "all", "side", "at", "text")

    def said(side: int) -> Column:
        texts = F.transform(F.filter("all", lambda x: x["side"] == side), lambda x: x["text"])
        return F.lower(F.trim(F.regexp_replace(F.array_join(texts, " "), r"[ \t\n]+", " ")))

    words = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    both = rows.select("video_id", said(0).alias("x"), said(1).alias("y")).where("x <> '' or y <> ''")
    # rows without a video are no video's
    both = both.withColumn("equal", (F.col("x") == F.col("y")) & F.col("video_id").isNotNull())
    same = F.zip_with(words("x"), words("y"), lambda p, q: p.eqNullSafe(q))
    first = F.when(F.col("video_id").isNull(), 0).when(~F.col("equal"), F.array_position(same, False) - 1).cast("int")
    both = both.select("video_id", F.size(words("x")).cast("long").alias("source_words"), F.size(words("y")).cast("long").alias("made_words"), first.alias("first_diff"), "equal")
    kind = F.when(F.col("first_diff") >= F.col("made_words"), "missing").when(F.col("first_diff") >= F.col("source_words"), "extra").when(~F.col("equal"), "diff")
    return both.select("video_id", "source_words", "made_words", "first_diff", kind.alias("kind"), "equal")


def block_lineage(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each new block the old blocks that its once-said word triples came from."""
    x, y = P.in_rows(old, "old", "idx", "text"), P.in_rows(new, "new", "idx", "text")
    said = lambda c: P.stream(F.col(c), lambda cue, p, n: cue["idx"])
    pairs = x.join(y, "video_id").select("video_id", F.explode_outer(F.array_distinct(P.shared_triples(said("new"), said("old")))).alias("x")).where("x is not null")
    kind = lambda df: df.schema["idx"].dataType
    return pairs.groupBy("video_id", F.col("x.a").cast(kind(new)).alias("idx")).agg(F.sort_array(F.collect_set(F.col("x.b").cast(kind(old)))).alias("old_ids"))


def speech_gap(cues: DataFrame, words: DataFrame) -> DataFrame:
    """Between neighbours the greater of the cue gap and the pause between their words; the cue gap without words. Words are rows, or `heard` in one row a video."""
    rows = _heard(cues, words)
    rows = rows.withColumn("near", P.touching(P.times(F.col("spans")), F.col("heard"), closed=False))

    def gaps(r: Column) -> Column:
        def gap(c: Column, i: Column) -> Column:
            plain, pause = F.get(r["spans"], i + 1)["start_ms"] - c["end_ms"], F.get(r["near"], i + 1)["first"] - F.get(r["near"], i)["last"]
            return F.struct(c["idx"].alias("idx"), F.when(pause.isNull(), plain).otherwise(F.greatest(plain, pause)).alias("gap_ms"))

        return F.transform(r["spans"], gap)

    return rows.select("video_id", F.explode_outer(P.let(F.struct("spans", "near"), gaps)).alias("x")).select("video_id", "x.*").where("gap_ms is not null")


def longest_silence(spans: DataFrame, words: DataFrame) -> DataFrame:
    """The longest stretch of each span without a word, lead-in and tail included; 0 without words. Words are rows, or `heard` in one row a video."""
    found = _each(_heard(spans, words), P.silences(P.times(F.col("spans")), F.col("heard")))
    return found.select("video_id", "idx", F.coalesce("x", F.lit(0)).alias("silence_ms"))


def pauses(words: DataFrame, least: int = 120) -> DataFrame:
    """Silences between words of a video of at least `least` ms. Words are rows, or `heard` in one row a video, as from views.spoken."""
    if "heard" in words.columns:
        def of(ws: Column) -> Column:
            pause = lambda h, i: F.get(ws, i + 1)["start_ms"] - h["end_ms"]
            return F.array_compact(F.transform(ws, lambda h, i: F.when(pause(h, i) >= least, F.struct(h["cue_idx"].alias("cue_idx"), h["w_pos"].alias("w_pos"), h["end_ms"].alias("ends"), pause(h, i).alias("pause_ms")))))

        return words.select("video_id", F.explode_outer(P.let(F.col("heard"), of)).alias("x")).where("x is not null").select("video_id", "x.*")
    order = Window.partitionBy("video_id").orderBy("cue_idx", "w_pos")
    p = words.select("video_id", "cue_idx", "w_pos", F.col("end_ms").alias("ends"), (F.lead("start_ms").over(order) - F.col("end_ms")).alias("pause_ms"))
    return p.where(F.col("pause_ms") >= least)


def pause_groups(segments: DataFrame, groups: Column | int) -> DataFrame:
    """Segments numbered into `groups` groups by their longest gaps; of equal gaps the later cuts first."""
    order = Window.partitionBy("video_id").orderBy("seg_id")
    g = segments.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(order))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc_nulls_last("gap"), F.desc("seg_id")))
    cut = (F.col("gap").isNotNull() & (F.col("_r") <= groups - 1)).cast("int")
    return g.withColumn("_r", rank).withColumn("group", F.sum(cut).over(order)).drop("_r", "gap")


def detect_offset(primary: DataFrame, secondary: DataFrame, share: int = 98, tolerance: int = 500, first: int = 10) -> DataFrame:
    """The constant offset between recordings with equal block counts and nearly equal words, or why there is none."""
    counts = primary.groupBy("video_id").agg(F.count("*").alias("n1")).join(secondary.groupBy("video_id").agg(F.count("*").alias("n2")), "video_id", "full_outer")
    j = primary.select("video_id", "idx", F.col("text").alias("x"), F.col("start_ms").alias("p")).join(secondary.select("video_id", "idx", F.col("text").alias("y"), F.col("start_ms").alias("s")), ["video_id", "idx"])
    j = j.withColumn("d", F.col("s") - F.col("p"))
    agg = j.groupBy("video_id").agg(F.count_if(F.lower("x") == F.lower("y")).alias("same"), F.min_by("d", "idx").alias("d0"), F.max(F.when(F.col("idx") <= first, F.col("d"))).alias("hi"), F.min(F.when(F.col("idx") <= first, F.col("d"))).alias("lo"))
    r = counts.join(agg, "video_id", "left")
    reason = F.when(F.col("n1").isNull() | F.col("n2").isNull(), "absent").when(F.col("n1") != F.col("n2"), "count").when(F.col("same") * 100 < F.col("n1") * share, "text").when(F.greatest(F.col("hi") - F.col("d0"), F.col("d0") - F.col("lo")) > tolerance, "drift")
    return r.withColumn("reason", reason).select("video_id", F.when(F.col("reason").isNull(), F.col("d0")).alias("offset_ms"), "reason")


def secondary_plan(secondary: DataFrame, primary: DataFrame, offsets: DataFrame) -> DataFrame:
    """How each secondary video can be derived: by offset, by resync, or why not."""
    j = secondary.join(primary.withColumn("has_primary", F.lit(True)), "video_id", "left").join(offsets, "video_id", "left")
    skip = F.when(F.col("has_primary").isNull(), "no primary source").when(F.col("reason") == "absent", "no own source")
    mode = F.when(skip.isNull(), F.when(F.col("offset_ms").isNotNull(), "secondary-offset").otherwise("secondary-resync"))
    return j.select("video_id", mode.alias("mode"), skip.alias("skipped"), "offset_ms")


def proportional_text(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """Words of each video's text dealt to its segments by cumulative share of `weight`; at least one each, the last takes the rest.

    segments: video_id, i (from 0), weight; texts: video_id, text. "One more than before, at least" is
    i plus the running maximum of target less index.
    """
    order = Window.partitionBy("video_id").orderBy("i")
    all_ = Window.partitionBy("video_id")
    texts = texts.select("video_id", F.filter(F.split("text", r"[ \t\n]+"), lambda w: w != "").alias("words"))
    # the segments need the number of words only; the words meet them once, in one row a video
    s = segments.join(texts.select("video_id", F.size("words").alias("n")), "video_id")
    s = s.withColumn("target", F.bround(F.col("n") * (F.sum("weight").over(order) / F.greatest(F.sum("weight").over(all_), F.lit(1)))).cast("int"))
    s = s.withColumn("end", F.when(F.col("i") == F.max("i").over(all_), F.col("n")).otherwise(F.col("i") + F.greatest(F.lit(1), F.max(F.col("target") - F.col("i")).over(order))))
    s = s.withColumn("begin", F.coalesce(F.lag("end").over(order), F.lit(0)))

    def dealt(r: Column) -> Column:
        def taken(m: Column) -> Column:
            some = F.slice(r["words"], (m["begin"] + 1).cast("int"), F.greatest(m["end"] - m["begin"], F.lit(0)).cast("int"))
            return F.array_join(F.when(m["begin"] < F.size(r["words"]), some).otherwise(F.array().cast("array<string>")), " ")

        return F.transform(r["marks"], lambda m: F.struct(m["i"].alias("i"), taken(m).alias("text")))

    rows = P.in_rows(s, "marks", "i", "begin", "end").join(texts, "video_id")
    return rows.select("video_id", F.explode_outer(P.let(F.struct("marks", "words"), dealt)).alias("x")).select("video_id", "x.*")


def uniform_word_times(cues: DataFrame) -> DataFrame:
    """Equal slices of a cue for its words, to the hundredth of a second."""
    w = cues.select("video_id", "idx", "start_ms", "end_ms", F.size(F.split("text", " ")).alias("n"), F.posexplode(F.split("text", " ")).alias("p", "word"))
    at = lambda p: F.expr(f"((start_ms + ({p} * (end_ms - start_ms)) div n + 5) div 10) * 10")
    return w.select("video_id", "idx", "p", "word", at("p").alias("start_ms"), at("(p + 1)").alias("end_ms"))
