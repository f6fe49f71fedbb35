"""Where to split a cue's text, and the time of that place from its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edits import CONJUNCTIONS, PREPOSITIONS, WIDTH, let

BLANK = r"[ \t\n\x0B\f\r]"


def break_near(text: Column, mid: Column, mark: str) -> Column:
    """The place after a mark and one blank that is nearest to `mid`, the earlier at a tie; null without one."""
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), mid), f"(?s)^(.*{mark}{BLANK})", 1))
    begin = F.greatest(mid, F.lit(1))
    right = F.length(F.regexp_extract(F.substring(text, begin, F.length(text)), f"(?s)^(.*?{mark}{BLANK})", 1))
    found = F.struct(left.alias("l"), F.when(right > 0, begin - 1 + right).alias("r"))
    return let(found, lambda f: F.when((f["l"] > 0) & (f["r"].isNull() | (mid - f["l"] <= f["r"] - mid)), f["l"]).otherwise(f["r"]))


def block_split(text: Column) -> Column:
    """Where a block is cut in two: after the sentence end nearest the middle, else the clause end, else the first word that ends at it or beyond.

    White space in the text is single blanks.
    """
    mid = F.floor(F.length(text) / 2).cast("int")
    begin = F.greatest(mid, F.lit(1))
    space = F.instr(F.substring(text, begin, F.length(text)), " ")
    return F.coalesce(break_near(text, mid, "[.!?]"), break_near(text, mid, "[,;:—]"), F.when(space > 0, begin - 1 + space))


def line_split(text: Column, width: int = WIDTH) -> Column:
    """Where a line over `width` breaks in two: of the breaks that leave both parts within it the best by kind, then balance; else the first at the middle or beyond."""
    n = F.length(text)

    def candidates(w: Column) -> Column:
        ends = F.aggregate(w, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.length(x) + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)) + 1)))
        return let(ends, lambda e: best(w, e))

    def best(w: Column, e: Column) -> Column:
        bare = lambda x: F.regexp_replace(F.lower(x), "[.,;:!?]+$", "")
        rank = lambda i: F.when(w[i].rlike("[.!?]$"), 0).when(w[i].rlike("[,;:]$"), 1).when(bare(F.get(w, i + 1)).isin(*CONJUNCTIONS), 2).when(bare(F.get(w, i + 1)).isin(*PREPOSITIONS), 3).otherwise(4)
        fits = lambda i: (e[i] <= width) & (n - e[i] - 1 <= width)
        options = F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 2), fits), lambda i: F.struct((rank(i) * 1000 + F.abs(2 * e[i] - n + 1)).alias("score"), e[i].alias("at")))
        return F.array_min(options)["at"]

    mid = F.floor(n / 2).cast("int")
    beyond = F.instr(F.substring(text, mid + 1, n), " ")
    fallback = F.when(beyond > 0, mid + beyond - 1)
    # both parts can be within the width only if the whole is within twice that
    near = F.when((n <= 2 * width + 1) & (F.instr(text, " ") > 0), let(F.split(text, " "), candidates))
    return F.when(n > width, F.coalesce(near, fallback))


def split_time(words: DataFrame, splits: DataFrame) -> DataFrame:
    """The time of each place (video_id, idx, at) in its cue's words: a word's end, or its start if the place is before it.

    Words stand as in "word word word"; a place beyond them has no time.
    """
    order = Window.partitionBy("video_id", "cue_idx").orderBy("w_pos")
    before = F.coalesce(F.sum(F.length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = words.withColumn("from", before).join(splits.withColumnRenamed("idx", "cue_idx"), ["video_id", "cue_idx"])
    reached = placed.where(F.col("from") + F.length("word") >= F.col("at"))
    time = F.when(F.col("from") >= F.col("at"), F.col("start_ms")).otherwise(F.col("end_ms"))
    return reached.groupBy("video_id", F.col("cue_idx").alias("idx"), "at").agg(F.min_by(time, "w_pos").alias("time_ms"))
