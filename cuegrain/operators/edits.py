"""Text edits: differences, fragments, block runs, splitting to width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_word, sentences
from . import flat as K
from . import packed as P

# Words before which a long line may break, by preference.
CONJUNCTIONS = ("and", "but", "or", "so", "because", "that", "which", "und", "et", "y")
PREPOSITIONS = ("of", "in", "on", "at", "to", "for", "with", "by", "from", "von", "de")
WIDTH = 84


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def strip_phrases(rows: DataFrame, phrases: list[str], text: str = "text") -> DataFrame:
    """Declared phrases go, longest first, whatever their case; only touched text is tidied."""
    pattern = "(?i)" + "|".join("\\Q" + p + "\\E" for p in sorted(phrases, key=len, reverse=True))
    cut = F.regexp_replace(text, pattern, "")
    return rows.withColumn("touched", cut != F.col(text)).withColumn(text, F.when(cut != F.col(text), F.trim(F.regexp_replace(cut, " {2,}", " "))).otherwise(F.col(text)))


def paragraph_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed paragraphs by position; one row with para_idx null where the counts differ. Both texts of a video meet in its row, by one shuffle."""
    part = lambda df, side: df.select("video_id", "para_idx", F.lit(side).alias("side"), "text")
    rows = P.in_rows(part(old, 0).unionByName(part(new, 1)), "all", "para_idx", "side", "text").where("video_id is not null")
    of = lambda run, side: F.filter(run, lambda x: x["side"] == side)
    made = lambda x, y, problem: F.struct(x["para_idx"].alias("para_idx"), x["text"].alias("old"), y["text"].alias("new"), F.lit(problem).cast("string").alias("problem"))

    def changed(run: Column) -> Column:
        return F.flatten(F.transform(of(run, 0), lambda x: F.transform(F.filter(of(run, 1), lambda y: y["text"] != x["text"]), lambda y: made(x, y, None))))

    runs = F.filter(P.runs(F.col("all"), lambda x: x["para_idx"]), lambda run: run[0]["para_idx"].isNotNull())
    none = lambda kind: F.lit(None).cast(kind)
    uneven = F.array(F.struct(none("int").alias("para_idx"), none("string").alias("old"), none("string").alias("new"), F.lit("count").alias("problem")))
    a, b = F.size(of(F.col("all"), 0)), F.size(of(F.col("all"), 1))
    found = F.when(a == b, F.flatten(F.transform(runs, changed))).when((a > 0) & (b > 0), uneven)
    return rows.select("video_id", F.explode_outer(found).alias("x")).where("x is not null").select("video_id", "x.*")


def edited_videos(old: DataFrame, new: DataFrame) -> DataFrame:
    """Videos with a cue (idx, text) of `old` that `new` has not. Both texts of a video meet in its row, by one shuffle."""
    part = lambda df, side: df.select("video_id", "idx", "text", F.lit(side).alias("side"))
    rows = P.in_rows(part(old, 0).unionByName(part(new, 1)), "all", "idx", "text", "side")

    def only_old(x: Column, i: Column) -> Column:
        after = F.get("all", i + 1)
        return (x["side"] == 0) & (after.isNull() | ~(after["idx"].eqNullSafe(x["idx"]) & after["text"].eqNullSafe(x["text"])))

    return rows.where(F.exists(F.transform("all", only_old), lambda found: found)).select("video_id")


def minimal_fragment(old: Column, new: Column) -> Column:
    """The changed middle of two texts, widened on both sides to 3 characters: old, new and its offset."""
    def found(old, new):
        if old is None or new is None:
            return None

        def common(x, y, size):
            """How many first characters two texts share, `size` at most; halving, by whole comparisons."""
            lo, hi = 0, size
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
            return lo

        least = min(len(old), len(new))
        p = common(old, new, least)
        s = common(old[::-1], new[::-1], least - p)
        k = next((k for k in range(4) if len(old) - p - s + min(k, p) + min(k, s) >= 3), 3)
        p, s = p - min(k, p), s - min(k, s)
        return old[p : len(old) - s], new[p : len(new) - s], p

    return F.udf(found, "struct<old_part:string,new_part:string,at:int>", useArrow=True)(old, new)


def block_runs(blocks: DataFrame, cues: DataFrame) -> DataFrame:
    """Where a list of blocks (list_id, video_id, id, text) stands as consecutive cues of equal text: the first start."""
    n = blocks.groupBy("list_id", "video_id").agg(F.count("*").alias("n"))
    hits = blocks.join(cues.select("video_id", "idx", "text"), ["video_id", "text"]).groupBy("list_id", "video_id", (F.col("idx") - F.col("id")).alias("shift")).agg(F.count("*").alias("c"), F.min("idx").alias("first_idx"))
    return hits.join(n, ["list_id", "video_id"]).where("c = n").groupBy("list_id", "video_id").agg(F.min("first_idx").alias("first_idx"))


def alike_blocks(old: DataFrame, new: DataFrame, share: int = 50, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Pairs of old and new blocks of a video (or other `keys`) that share over `share` percent of their word trigrams: old, new, score."""
    def grams(b: DataFrame, name: str) -> DataFrame:
        def triples(w: Column) -> Column:
            return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

        g = let(F.transform(F.split("text", " "), norm_word), triples)
        return b.select(*keys, F.col("idx").alias(name), F.size(g).alias(f"n_{name}"), F.explode(g).alias("g"))

    pairs = grams(old, "old").join(grams(new, "new"), [*keys, "g"]).groupBy(*keys, "old", "new", "n_old", "n_new").agg(F.count("*").alias("c"))
    return pairs.select(*keys, "old", "new", F.expr("c * 100 div (n_old + n_new - c)").alias("score")).where(F.col("score") > share)


def similar_blocks(old: DataFrame, new: DataFrame, share: int = 50) -> DataFrame:
    """Old and new blocks of a video that are each other's most similar, by word trigrams shared over all (in percent).

    Of blocks with the same trigrams only the first can be one of them, as its equals tie and it comes
    first. Sets that both versions have are each other's best. Each other set is looked up by its
    rarest trigrams, as many as hold one that a set over `share` must share with it, and those found
    are counted whole.
    """
    def matched(old, new):
        from collections import Counter
        from itertools import chain

        def firsts(texts):
            made = {}
            for i, t in enumerate(texts):
                if t is not None:
                    w = t.split(" ")
                    made.setdefault(frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)]), i)
            return made

        def best(open_, others):
            often, index, found = Counter(chain.from_iterable(others)), {}, {}
            for g in open_:
                enough = -(-(share + 1) * len(g) // 100)
                for x in sorted(g, key=lambda x: (often[x], x))[: len(g) - enough + 1]:
                    index.setdefault(x, []).append(g)
            for h, place in others.items():
                for g in {g for x in index.keys() & h for g in index[x]}:
                    common = len(g & h)
                    score = common * 100 // (len(g) + len(h) - common)
                    if score > share:
                        found[g] = min(found.get(g, (0, 0, None)), (-score, place, h))
            return found

        a, b = firsts(old), firsts(new)
        pairs = [(a[g], b[g], 100) for g in a.keys() & b.keys()] if share < 100 else []
        ours, theirs = best([g for g in a if g not in b], b), best([g for g in b if g not in a], a)
        return pairs + [(a[g], place, -score) for g, (score, place, h) in ours.items() if h in theirs and theirs[h][2] == g]

    x, y = P.in_rows(old, "old", "idx", "text"), P.in_rows(new, "new", "idx", "text")
    words = lambda c: F.transform(c, lambda b: F.array_join(P.normed_words(b["text"]), " "))
    rows = x.join(y, "video_id").withColumn("pairs", F.udf(matched, "array<struct<a:int,b:int,score:bigint>>", useArrow=True)(words("old"), words("new")))
    found = let(F.struct("old", "new", "pairs"), lambda r: F.transform(r["pairs"], lambda p: F.struct(F.get(r["old"], p["a"])["idx"].alias("old"), F.get(r["new"], p["b"])["idx"].alias("new"), p["score"].alias("score"))))
    return rows.select("video_id", F.explode_outer(found).alias("x")).where("x is not null").select("video_id", "x.*")


def split_spans(spans: DataFrame, pauses: DataFrame, parts: int | None = 3, margin: int = 200) -> DataFrame:
    """Each span cut into `parts` at its longest inner pauses, evenly where there are too few.

    spans: video_id, idx, start_ms, end_ms, and their own `parts` if none are given; pauses:
    video_id, r_start, r_end. One row a part.
    """
    from .align import interval_join

    if parts is not None:
        spans = spans.withColumn("parts", F.lit(parts))
    inner = interval_join(spans, pauses).where((F.col("start_ms") + margin <= F.col("r_start")) & (F.col("r_end") <= F.col("end_ms") - margin))
    rank = F.row_number().over(Window.partitionBy("video_id", "idx").orderBy(F.desc(F.col("r_end") - F.col("r_start")), "r_start"))
    chosen = inner.withColumn("r", rank).where(F.col("r") < F.col("parts")).groupBy("video_id", "idx").agg(F.array_sort(F.collect_list(F.struct(F.col("r_start").alias("a"), F.col("r_end").alias("z")))).alias("cuts"))
    j = spans.join(chosen, ["video_id", "idx"], "left").withColumn("by_pause", (F.col("parts") == 1) | F.coalesce(F.size("cuts") == F.col("parts") - 1, F.lit(False)))
    step = F.expr("(end_ms - start_ms) div parts")
    even = F.transform(F.slice(F.sequence(F.lit(1), F.col("parts")), 1, F.col("parts") - 1), lambda i: F.struct((F.col("start_ms") + step * i).alias("a"), (F.col("start_ms") + step * i).alias("z")))
    j = j.withColumn("cuts", F.when(F.col("by_pause") & F.col("cuts").isNotNull(), F.col("cuts")).otherwise(even))
    p = j.select("video_id", "idx", "start_ms", "end_ms", "by_pause", "parts", "cuts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    begin = F.when(F.col("part") == 0, F.col("start_ms")).otherwise(F.get("cuts", F.col("part") - 1)["z"])
    end = F.when(F.col("part") == F.col("parts") - 1, F.col("end_ms")).otherwise(F.get("cuts", F.col("part"))["a"])
    return p.select("video_id", "idx", "part", begin.alias("a_ms"), end.alias("z_ms"), "by_pause")


def snap_to_pause(targets: DataFrame, pauses: DataFrame, reach: int = 3000, least: int = 200, weight: int = 5) -> DataFrame:
    """The middle of the pause that scores best for each target time: distance less size / weight, within reach; else the target.

    targets: video_id, idx, t; pauses: video_id, r_start, r_end.
    """
    from .align import interval_join

    near = targets.select("video_id", "idx", "t", (F.col("t") - reach).alias("start_ms"), (F.col("t") + reach).alias("end_ms"))
    marks = pauses.where(F.col("r_end") - F.col("r_start") > least).withColumn("mid", F.expr("(r_start + r_end) div 2")).withColumn("size", F.col("r_end") - F.col("r_start"))
    hit = interval_join(near, marks.select("video_id", F.col("mid").alias("r_start"), F.col("mid").alias("r_end"), "size"), closed=True).withColumn("dist", F.abs(F.col("r_start") - F.col("t"))).where(F.col("dist") < reach)
    best = hit.groupBy("video_id", "idx").agg(F.min_by("r_start", F.struct(F.col("dist") * weight - F.col("size"), "r_start")).alias("snapped"))
    return targets.join(best, ["video_id", "idx"], "left").select("video_id", "idx", "t", F.coalesce("snapped", "t").alias("snapped"))


def _cut(text: Column, width: int, once: bool) -> Column:
    wide = (F.length(text) > width) & (F.instr(text, " ") > 0)
    breaks = dict.fromkeys(CONJUNCTIONS, 2) | dict.fromkeys(PREPOSITIONS, 3)
    return F.coalesce(K.column(K.split_to_width, "array<string>", F.when(wide, text), width=width, breaks=breaks, once=once), F.array(text))


def split_once(text: Column, width: int = WIDTH) -> Column:
    """A text over `width` cut in two at its best space: both halves within width if one can, the better break, nearest the middle; see flat.halves.

    Words are only looked at where both halves may be within width, so a text of any length costs its length.
    """
    return _cut(text, width, True)


def split_to_width(text: Column, width: int = WIDTH) -> Column:
    """Parts of a text within width, in order; single words stay whole.

    What is too wide is cut at its best space, and so is what that leaves. Two cuts leave no part with
    a space longer than two thirds of what it was, also around long words.
    """
    return _cut(text, width, False)


def blocks(paragraphs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Sentences of paragraphs cut to width, numbered from 1 in each video."""
    # the outer form: see views.paragraphs
    sent = paragraphs.select("video_id", "para_idx", F.posexplode_outer(sentences(F.col("text"))).alias("s", "sentence")).where("sentence is not null")
    cut = sent.select("video_id", "para_idx", "s", F.posexplode_outer(split_to_width(F.col("sentence"), width)).alias("i", "text"))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("para_idx", "s", "i"))
    return cut.select("video_id", number.alias("id"), "para_idx", "text")
