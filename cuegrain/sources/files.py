"""Files of timed text to rows. Each parser works on a DataFrame with the whole text of each file, so it
runs on any table that holds such text; the readers below it add the scan and the path's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import timecode_to_ms

TIME_LINE = r"^([0-9]{2,}:[0-5][0-9]:[0-5][0-9],[0-9]{3}) --> ([0-9]{2,}:[0-5][0-9]:[0-5][0-9],[0-9]{3})"
SPEECH = "struct<language:string,segments:array<struct<id:int,start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string>>>>>"
WORK_ITEMS = "struct<number:bigint,title:string,state:string,draft:boolean,updated_at:string,pull_request:struct<merged_at:string>,labels:array<struct<name:string>>,assignees:array<struct<login:string>>>"
MARKERS = "array<struct<time:double,tc:string,text:string,comment:string>>"
MARKER_COMMENT = r"<!-- markers:([A-Za-z0-9+/=]*) -->"


def parse_cues(files: DataFrame, text: str = "file") -> DataFrame:
    """Cues of each file (key columns, idx, start_ms, end_ms, text).

    A byte-order mark goes; chunks are cut at blank lines and kept with three lines or more, a whole
    number first and a valid time line second; the rest is the text.
    """
    keys = [c for c in files.columns if c != text]
    body = F.regexp_replace(F.regexp_replace(F.col(text), "^\ufeff", ""), "\r\n?", "\n")
    chunks = files.select(*keys, F.explode(F.split(F.regexp_replace(body, "^\n+|\n+$", ""), "\n[ \t]*\n+")).alias("_c"))
    lines = chunks.select(*keys, F.split("_c", "\n").alias("_l")).where(F.size("_l") >= 3)
    idx, time = F.expr("try_cast(trim(_l[0]) as int)"), F.trim(F.col("_l")[1])
    cut = lines.select(*keys, idx.alias("idx"), timecode_to_ms(F.regexp_extract(time, TIME_LINE, 1)).alias("start_ms"), timecode_to_ms(F.regexp_extract(time, TIME_LINE, 2)).alias("end_ms"), F.array_join(F.slice("_l", 3, F.size("_l")), "\n").alias("text"))
    return cut.where("idx is not null and start_ms is not null and end_ms is not null")


def parse_speech(files: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Segments and words of recognised speech; times to milliseconds by truncation; words without text or times go."""
    keys = [c for c in files.columns if c != json]
    ms = lambda c: (F.col(c) * 1000).cast("bigint")
    # the outer form: for the other one Spark puts a filter on the array before it, and so parses twice
    s = files.select(*keys, F.posexplode_outer(F.from_json(json, SPEECH)["segments"]).alias("n", "s")).where("n is not null")
    segments = s.select(*keys, F.col("s.id").alias("seg_id"), ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), F.col("s.text").alias("text"))
    w = s.select(*keys, F.col("s.id").alias("seg_id"), F.posexplode_outer("s.words").alias("w_idx", "w"))
    words = w.where("w.word is not null and w.start is not null and w.end is not null").select(*keys, "seg_id", "w_idx", F.col("w.word").alias("word"), ms("w.start").alias("start_ms"), ms("w.end").alias("end_ms"))
    return segments, words


def clamp_words(words: DataFrame | None, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Words held within their segment; those of no length last 1 ms. Without `words` the segments hold theirs, as an array of (w_idx, word, start_ms, end_ms)."""
    s = segments.select(*keys, "seg_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("z"), *[c for c in segments.columns if c == "words" and words is None])
    if words is None:
        j = s.select(*keys, "seg_id", "a", "z", F.explode_outer("words").alias("w")).where("w is not null").select(*keys, "seg_id", "a", "z", "w.*")
    else:
        j = words.join(s, [*keys, "seg_id"])
    start = F.least(F.greatest("start_ms", "a"), "z")
    end = F.least(F.greatest("end_ms", "a"), "z")
    return j.withColumn("_s", start).withColumn("_e", F.when(end <= start, start + 1).otherwise(end)).select(*keys, "seg_id", "w_idx", "word", F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"))


def parse_timecodes(files: DataFrame, text: str = "file") -> DataFrame:
    """`#N | start | end` rows; the last line of an id wins."""
    keys = [c for c in files.columns if c != text]
    lines = files.select(*keys, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    part = lambda i: F.regexp_extract("line", r"^#([0-9]+) \| ([0-9:,]+) \| ([0-9:,]+)\s*$", i)
    rows = lines.where(part(1) != "").select(*keys, part(1).cast("int").alias("id"), "n", timecode_to_ms(part(2)).alias("start_ms"), timecode_to_ms(part(3)).alias("end_ms"))
    return rows.groupBy(*keys, "id").agg(F.max_by(F.struct("start_ms", "end_ms"), "n").alias("t")).select(*keys, "id", "t.start_ms", "t.end_ms")


def parse_transcript(files: DataFrame, omit: list[str], text: str = "file") -> DataFrame:
    """Paragraphs: whole-line remarks in brackets go, then blank lines cut (single lines where there are none); declared phrases go."""
    keys = [c for c in files.columns if c != text]
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(r"^\[[^\[\]]+\]$"))
    kept = F.array_join(lines, "\n")
    cut = F.when(kept.rlike("\n[ \t]*\n"), F.split(kept, "\n[ \t]*\n+")).otherwise(F.split(kept, "\n"))
    spoken = F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin(*[o.lower() for o in omit]))
    return files.select(*keys, F.posexplode(spoken).alias("para_idx", "text"))


def parse_markers(issues: DataFrame, body: str = "body") -> DataFrame:
    """Rows of the last hidden marker comment; anything malformed gives none."""
    keys = [c for c in issues.columns if c != body]
    last = F.element_at(F.regexp_extract_all(body, F.lit(MARKER_COMMENT), 1), -1)
    rows = F.from_json(F.decode(F.try_to_binary(last, F.lit("base64")), "utf-8"), MARKERS)
    return issues.where(F.size(F.regexp_extract_all(body, F.lit(MARKER_COMMENT), 1)) > 0).select(*keys, F.inline(rows))


def parse_work_items(rows: DataFrame, json: str = "json") -> DataFrame:
    """Issues and pull requests with one state each: merged, closed, draft or open."""
    x = rows.select(F.from_json(json, WORK_ITEMS).alias("x"))
    state = F.when(F.col("x.pull_request.merged_at").isNotNull(), "merged").when(F.col("x.state") == "closed", "closed").when(F.col("x.draft"), "draft").otherwise("open")
    return x.select("x.number", "x.title", state.alias("state"), F.col("x.assignees")[0]["login"].alias("assignee"), "x.updated_at")


def encoding(content: Column) -> Column:
    """utf-16 by its mark, binary by a NUL in the first 8000 bytes, invalid utf-8, or text."""
    head = F.hex(F.substring(content, 1, 2))
    nul = F.instr(F.substring(content, 1, 8000).cast("string"), "\x00") > 0
    return F.when(head.isin("FFFE", "FEFF"), "utf-16").when(nul, "binary").when(~F.is_valid_utf8(content.cast("string")), "invalid").otherwise("text")


def path_parts(path: Column) -> dict[str, Column]:
    """Talk, video and kind of file, from talks/<talk>/<video>/<folder>/<name>."""
    part = lambda i: F.regexp_extract(path, r"/([^/]+)/([^/]+)/(?:folder=)?(source|final)/([^/]+)$", i)
    return {"talk_id": part(1), "video_slug": part(2), "kind": F.concat_ws("/", part(3), part(4))}


def read_cues(spark: SparkSession, glob: str) -> DataFrame:
    """Cues of all files of a glob, with talk_id, video_slug and kind from the path."""
    files = spark.read.text(glob, wholetext=True).select(*[c.alias(n) for n, c in path_parts(F.col("_metadata.file_path")).items()], F.col("value").alias("file"))
    return parse_cues(files)


def write_cues(files: DataFrame, path: str, key: str = "video_id") -> None:
    """One folder for each video, its cue file as text."""
    files.select(key, F.col("file").alias("value")).write.partitionBy(key).text(path, lineSep="\x00")


def discover(spark: SparkSession, glob: str) -> DataFrame:
    """Videos that have both a final cue file and a source one."""
    found = spark.read.format("binaryFile").load(glob).select(*[c.alias(n) for n, c in path_parts(F.col("path")).items()])
    final = found.where(F.col("kind").startswith("final/"))
    return final.join(found.where(F.col("kind").startswith("source/")), ["talk_id", "video_slug"], "left_semi").select("talk_id", "video_slug").distinct()


def audit_encodings(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", encoding(F.col("content")).alias("encoding"))


def renumber(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(order)))
