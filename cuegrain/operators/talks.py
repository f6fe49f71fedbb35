"""Talks: metadata, its contract, build manifests, pages with their videos, edit documents, file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugify
from .html import players
from .pages import text_lines, title
from .terms import duplicate_runs

META = "struct<title:string,date:string,location:string,language:string,other_languages:array<string>,subtitle_omit:array<string>,videos:array<struct<slug:string,title:string,video_ref:string,vimeo_url:string>>>"
# Languages that a talk may have, the shapes of slugs, talk ids, refs, links and dates, and names of languages in a page's header.
LANGUAGES = ("de", "en", "es", "fr", "hi", "it", "mr", "pt", "ru")
SLUG = "^[A-Za-z0-9_][A-Za-z0-9_.-]{0,63}$"
TALK_ID = "^[0-9]{4}-[0-9]{2}-[0-9]{2}_[A-Za-z0-9_.-]{1,80}$"
GIT_REF = "^[A-Za-z0-9_][A-Za-z0-9._/-]{0,254}$"
VIDEO_LINK = "^https://(www[.])?(vimeo[.]com|player[.]vimeo[.]com/video)/[0-9]+(/[0-9a-f]+)?/?$"
DATE = "^....-..-..$"
LANGUAGE_NAMES = {"english": "en", "french": "fr", "german": "de", "hindi": "hi", "italian": "it", "marathi": "mr", "russian": "ru", "spanish": "es"}


def parse_talks(files: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Talks and their videos (pos from 0) from one metadata document each; key columns stay."""
    keys = [c for c in files.columns if c != json]
    m = files.select(*keys, F.from_json(json, META).alias("m"))
    talks = m.select(*keys, "m.title", "m.date", "m.location", "m.language", "m.other_languages", "m.subtitle_omit")
    videos = m.select(*keys, F.posexplode("m.videos").alias("pos", "v")).select(*keys, "pos", "v.*")
    return talks, videos


def metadata_contract(talks: DataFrame, videos: DataFrame, key: str = "talk_id") -> DataFrame:
    """Violations of talk metadata (key, violation), each once a talk."""
    no = lambda c: F.coalesce(c, F.lit(True))
    blank = lambda c: no(~F.col(c).rlike("[^ \t\r\n]"))
    listed = lambda rules: F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))).alias("violation")
    of_talk = {
        "no title": blank("title"), "bad date": no(~F.col("date").rlike(DATE)), "bad language": no(~F.col("language").isin(*LANGUAGES)),
        "bad omit list": F.coalesce(F.exists("subtitle_omit", lambda p: F.coalesce(F.trim(p) == "", F.lit(True))), F.lit(False)),
    }
    counted = videos.withColumn("n", F.count("*").over(Window.partitionBy(key, "slug")))
    of_video = {
        "bad slug": ~valid_slug(F.col("slug")), "duplicate slug": F.col("slug").isNotNull() & (F.col("n") > 1),
        "no video title": F.col("title").isNull(), "plain link": F.col("vimeo_url").isNotNull(),
    }
    return talks.select(key, listed(of_talk)).unionByName(counted.select(key, listed(of_video))).distinct()


def artifact_contracts(metadata: DataFrame, speech: DataFrame, timecodes: DataFrame) -> DataFrame:
    """Per talk (video_id) its violations of all contracts, and the first failing artifact with its first violation."""
    part = lambda df, rank, name: df.select("video_id", F.lit(rank).alias("rank"), F.lit(name).alias("artifact"), "violation")
    rows = part(metadata, 0, "metadata").unionByName(part(speech, 1, "speech")).unionByName(part(timecodes, 2, "timecodes"))
    found = rows.groupBy("video_id").agg(F.count("*").alias("violations"), F.min(F.struct("rank", "violation", "artifact")).alias("f"))
    return found.select("video_id", "violations", F.col("f.artifact").alias("artifact"), F.col("f.violation").alias("violation"))


def parse_manifests(files: DataFrame, text: str = "file") -> DataFrame:
    """role, mode and primary_slug from `name: value` lines of build manifests; a missing or empty value is null."""
    keys = [c for c in files.columns if c != text]
    value = lambda name: F.nullif(F.regexp_extract(text, f"(?m)^{name}:[ \t]*['\"]?([^'\"\r\n]*?)['\"]?[ \t]*$", 1), F.lit(""))
    return files.select(*keys, *[value(n).alias(n) for n in ("role", "mode", "primary_slug")])


def whole(value: Column, shape: str) -> Column:
    """Whether all of a value has a shape; a line end after it is part of the value. Null is not valid."""
    return F.coalesce(value.rlike(shape[:-1] + r"\z"), F.lit(False))


def valid_talk_id(value: Column) -> Column:
    return whole(value, TALK_ID)


def valid_slug(value: Column) -> Column:
    return whole(value, SLUG)


def valid_link(value: Column) -> Column:
    """A video's link or player link, with or without its key."""
    return whole(value, VIDEO_LINK)


def valid_ref(value: Column) -> Column:
    """A branch or tag that may be checked out: no path steps, nothing that reads as an option."""
    return whole(value, GIT_REF) & ~value.contains("..") & ~value.contains("//") & ~value.endswith("/")


def build_modes(videos: DataFrame, manifests: DataFrame, key: str = "video_id") -> DataFrame:
    """role and mode of every video; strict without a manifest."""
    j = videos.select(key).join(manifests.select(key, "role", "mode"), key, "left")
    return j.select(key, F.coalesce("role", F.lit("strict")).alias("role"), F.coalesce("mode", F.lit("strict")).alias("mode"))


def manifest_files(derived: DataFrame, run_id: str, built_at: Column | None = None, key: str = "video_id") -> DataFrame:
    """The manifest text (key, file) of each derived video; `derived` has mode and primary_slug. Built now unless a time is given."""
    when = F.date_format(F.current_timestamp() if built_at is None else built_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pairs = [("role", F.lit("secondary")), ("mode", F.col("mode")), ("primary_slug", F.col("primary_slug")), ("built_at", F.concat(F.lit("'"), when, F.lit("'"))), ("run_id", F.lit(run_id))]
    return derived.select(key, F.concat(*[x for n, v in pairs for x in (F.lit(f"{n}: "), v.cast("string"), F.lit("\n"))]).alias("file"))


def write_manifests(files: DataFrame, path: str, key: str = "video_id") -> None:
    """One folder for each video, its manifest as text."""
    files.select(key, F.col("file").alias("value")).write.partitionBy(key).text(path, lineSep="\x00")


def declared_languages(header: Column) -> Column:
    """Codes from the "Talk Language:" line of a text, first the talk's own; ["en"] without one. Unknown names give their first two letters."""
    line = F.regexp_extract(header, "(?m)^Talk Language:([^|\r\n]*)", 1)
    names = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(F.lower(x))), lambda x: x != "")
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    codes = F.transform(names, lambda x: F.coalesce(F.try_element_at(table, x), F.substring(x, 1, 2)))
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("en")))


def page_videos(pages: DataFrame) -> DataFrame:
    """Embedded players of each page in order: pos (from 0), title, slug (unique in the page) and link.

    The title is the part of the player box's info line between date and first comma; on pages
    without such boxes it is the heading or bold line right before the frame; else `Video N`, where
    boxes without a player count too.
    """
    found = players(pages)
    number = F.concat(F.lit("Video "), F.col("number").cast("string"))
    rows = found.withColumn("pos", (F.row_number().over(Window.partitionBy("page_id").orderBy("number")) - 1).cast("int"))
    named = rows.withColumn("title", F.coalesce(F.nullif("label", F.lit("")), number)).withColumn("base", slugify(F.col("title")))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "base").orderBy("pos")))
    slug = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n"))
    return named.select("page_id", "pos", "title", slug.alias("slug"), F.concat(F.lit("https://vimeo.com/"), "video").alias("link"))


def ingest(pages: DataFrame) -> DataFrame:
    """One row a page: title, lines left after repeated runs go, languages, videos."""
    lines = text_lines(pages)
    kept = duplicate_runs(lines.select(F.col("page_id").alias("doc_id"), "pos", "line")).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("lines"))
    header = lines.where(F.col("line").startswith("Talk Language:")).groupBy("page_id").agg(F.min_by("line", "pos").alias("header"))
    videos = page_videos(pages).groupBy("page_id").agg(F.array_sort(F.collect_list("slug")).alias("s"))
    j = title(pages).join(kept, "page_id", "left").join(header, "page_id", "left").join(videos, "page_id", "left")
    return j.select(
        "page_id", "title", F.coalesce("lines", F.lit(0)).alias("lines"), F.array_join(declared_languages(F.coalesce("header", F.lit(""))), ",").alias("languages"),
        F.coalesce(F.array_join("s", ","), F.lit("")).alias("videos"),
    )


def is_content_path(path: Column, lang: str) -> Column:
    """Whether a file holds prose of that language: its transcript, its text, or a cue file whose name has the code."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return name.isin(f"transcript_{lang}.txt", f"{lang}.txt") | (name.endswith(".srt") & F.contains(F.substring(name, F.lit(1), F.length(name) - 4), F.lit(lang)))


def is_scanned_path(path: Column, unscanned: tuple[str, ...] = ("tests/fixtures/",)) -> Column:
    """Whether a file is checked at all: not if it is in a folder of captured raw input."""
    hit = F.lit(False)
    for prefix in unscanned:
        hit = hit | F.replace(path, F.lit("\\"), F.lit("/")).startswith(prefix)
    return ~hit


ENTRY = "map<string,string>"
MARKERS = "array<struct<time:double,tc:string,text:string,comment:string>>"


def flatten_doc(docs: DataFrame, json: str = "doc") -> DataFrame:
    """One row for each leaf of an edit document: key columns, path (a JSON array) and leaf (JSON).

    The document maps entry names to entries. Entries named srt_edits_... map block numbers to
    texts; others have marks, edits (a value, or a map of values), mode and markers, which are told
    by time and text.
    """
    keys = [c for c in docs.columns if c != json]
    path = lambda *parts: F.to_json(F.array(*parts))
    e = docs.select(*keys, F.explode(F.from_json(json, "map<string,string>")).alias("name", "entry")).withColumn("m", F.from_json("entry", ENTRY))
    blocks = e.where(F.col("name").startswith("srt_edits_")).select(*keys, "name", F.explode("m").alias("k", "v")).select(*keys, path("name", F.lit("blocks"), "k").alias("path"), F.to_json(F.array("v")).alias("leaf"))
    rest = e.where(~F.col("name").startswith("srt_edits_"))
    part = lambda kind: rest.select(*keys, "name", F.explode(F.from_json(F.try_element_at("m", F.lit(kind)), ENTRY)).alias("k", "v"))
    marks = part("marks").select(*keys, path("name", F.lit("marks"), "k").alias("path"), F.to_json(F.array("v")).alias("leaf"))
    edits = part("edits")
    nested = edits.where(F.col("v").startswith("{")).select(*keys, "name", "k", F.explode(F.from_json("v", ENTRY)).alias("i", "x")).select(*keys, path("name", F.lit("edits"), "k", "i").alias("path"), F.to_json(F.array("x")).alias("leaf"))
    plain = edits.where(~F.col("v").startswith("{")).select(*keys, path("name", F.lit("edits"), "k").alias("path"), F.to_json(F.array("v")).alias("leaf"))
    mode = rest.where(F.try_element_at("m", F.lit("mode")).isNotNull()).select(*keys, path("name", F.lit("mode")).alias("path"), F.to_json(F.array(F.try_element_at("m", F.lit("mode")))).alias("leaf"))
    marker = rest.select(*keys, "name", F.explode(F.from_json(F.try_element_at("m", F.lit("markers")), MARKERS)).alias("k"))
    markers = marker.select(*keys, path("name", F.lit("markers"), F.concat_ws("|", F.col("k.time").cast("string"), "k.text")).alias("path"), F.to_json("k").alias("leaf"))
    out = blocks
    for more in (marks, nested, plain, mode):
        out = out.unionByName(more)
    # a leaf that is a text is its JSON string: the array around it made it one
    return out.withColumn("leaf", F.substring("leaf", F.lit(2), F.length("leaf") - 2)).unionByName(markers)


def unflatten_doc(leaves: DataFrame) -> DataFrame:
    """The documents whose leaves these are (key columns, path, leaf): entries by name, one JSON text each; entries without items go."""
    keys = [c for c in leaves.columns if c not in ("path", "leaf")]
    p = leaves.withColumn("p", F.from_json("path", "array<string>")).withColumn("name", F.col("p")[0]).withColumn("kind", F.col("p")[1])
    text = F.from_json(F.concat(F.lit("["), "leaf", F.lit("]")), "array<string>")[0]
    items = lambda kind, size, k: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.size("p") == size), F.struct(F.col("p")[k].alias("key"), text.alias("value"))))))
    nested = F.array_sort(F.collect_list(F.when((F.col("kind") == "edits") & (F.size("p") == 4), F.struct(F.col("p")[2].alias("k"), F.col("p")[3].alias("i"), text.alias("v")))))
    marker = F.from_json("leaf", "struct<time:double,tc:string,text:string,comment:string>")
    agg = p.groupBy(*keys, "name").agg(
        items("blocks", 3, 2).alias("blocks"), items("marks", 3, 2).alias("marks"), items("edits", 3, 2).alias("plain"), nested.alias("nested"),
        F.max(F.when(F.col("kind") == "mode", text)).alias("mode"), F.array_sort(F.collect_list(F.when(F.col("kind") == "markers", marker))).alias("markers"),
    )
    by_key = F.transform(F.array_distinct(F.transform("nested", lambda x: x["k"])), lambda k: F.struct(k.alias("key"), F.to_json(F.map_from_entries(F.transform(F.filter("nested", lambda x: x["k"] == k), lambda x: F.struct(x["i"].alias("key"), x["v"].alias("value"))))).alias("value")))
    edits = F.map_concat("plain", F.map_from_entries(by_key))
    whole = F.when(F.col("name").startswith("srt_edits_"), F.to_json("blocks")).otherwise(F.to_json(F.struct("mode", "marks", "markers", edits.alias("edits"))))
    return agg.select(*keys, "name", whole.alias("entry"))
