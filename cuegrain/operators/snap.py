"""Cues timed by the words that were heard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat as K
from . import packed as P
from .cues import LIMITS, Limits, chars


def in_hearing(rows: DataFrame, words: DataFrame, kernel, fields: str, **fixed) -> DataFrame:
    """The rows (video_id, `fields`) that `kernel` makes of each video's arrays in `rows` and its heard words.

    Words are rows, or in one row a video: `heard`, as from views.spoken, or `voiced`, as from views.voiced, of which they are made in the kernel.
    """
    arrays = [F.col(c) for c in rows.columns if c != "video_id"]
    said, spoken = next((c for c in ("heard", "voiced") if c in words.columns), None), K.spoken
    if said is None:
        said, words = "heard", P.in_rows(words, "heard", "cue_idx", "w_pos", "word", "start_ms", "end_ms")
    of = kernel if said == "heard" else lambda *arrays, **fixed: kernel(*arrays[:-1], spoken(arrays[-1]), **fixed)
    # a full join puts no filter before either side, so both read one shuffle of texts; videos that only have words give no rows
    return P.rows_of(rows.join(words, "video_id", "full"), K.column(of, f"array<struct<{fields}>>", *arrays, F.col(said), **fixed))


def _cues(cues: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """Cues in one row a video with these columns beside idx, and the field of its type."""
    return P.in_rows(cues, "cues", "idx", *columns), f"idx:{cues.schema['idx'].dataType.simpleString()}"


def _anchors(rows: DataFrame, written: Column, heard: Column) -> DataFrame:
    """`rows` with `anchors`: places (a, b) of words in the arrays `written` and `heard` (w, v)."""
    runs = F.flatten(F.transform(P.shared_triples(P.numbered(written), P.numbered(heard)), lambda x: F.array(*[F.struct((x["a"] + k).alias("a"), (x["b"] + k).alias("b")) for k in range(3)])))
    return P.rising(rows.withColumn("anchors", P.first_of_each(runs)), "anchors")


def word_anchors(written: DataFrame, heard: DataFrame) -> DataFrame:
    """Written words (j) that are certainly heard ones (i): those of word triples that each side has once, the longest run of them that rises in both.

    Both sides number a video's words from 0.
    """
    both = P.in_rows(written, "written", "j", "w").join(P.in_rows(heard, "said", "i", "w"), "video_id")
    found = _anchors(both, F.col("written"), F.col("said")).select("video_id", F.explode_outer("anchors").alias("x")).where("x is not null")
    return found.select("video_id", F.col("x.a").alias("j"), F.col("x.b").alias("i"))


def cue_times(cues: DataFrame, words: DataFrame) -> DataFrame:
    """The span of each cue's words as heard; cues without one anchored word are left out."""
    rows, idx = _cues(cues, "text")
    return in_hearing(rows, words, K.cue_times, f"{idx},start_ms:bigint,end_ms:bigint")


def pair_boundaries(cues: DataFrame, words: DataFrame, moves: Column | None = None, least: int = 700, pause: int = 150, limits: Limits = LIMITS) -> DataFrame:
    """For a cue over the target speed the word edge at which to hand over to the next one, if that slows the faster of the two by over 1 character a second.

    Edges at pauses come first, then those nearest the place where both would read equally fast. Each
    pair is judged on its own.
    """
    judged = cues.withColumns({"chars": chars(), "moves": F.lit(True) if moves is None else moves})
    rows, idx = _cues(judged, "start_ms", "end_ms", "chars", "moves")
    return in_hearing(rows, words, K.pair_boundaries, f"{idx},boundary_ms:bigint,at_pause:boolean", least=least, pause=pause, cps=limits.target_cps)


def snap_to_speech(cues: DataFrame, words: DataFrame, least: int = 1000, limits: Limits = LIMITS) -> DataFrame:
    """Cues on the words that they transcribe: overlaps trimmed, pauses shared with the next cue first, boundaries proposed, short cues grown.

    Cues that no word matches keep their times and do not move; `matched` says which those are.
    """
    rows, idx = _cues(cues.withColumn("chars", chars()), "text", "start_ms", "end_ms", "chars")
    fields = f"{idx},start_ms:bigint,end_ms:bigint,matched:boolean,boundary_ms:bigint"
    return in_hearing(rows, words, K.snapped, fields, least=least, gap=limits.min_gap, cps=limits.target_cps, least_part=700, pause=150)
