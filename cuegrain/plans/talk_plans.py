"""Plans on talks: metadata, contracts, manifests, pages with videos, paths, edit documents, files on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import views as V
from ..operators import html as H
from ..operators import quality as Q
from ..operators import talks as T
from ..operators import validate as K
from ..operators.pages import text_lines
from ..sources import files as S
from ..staging import shared_dir, staged
from ..streaming import jobs as J
from .registry import ORACLES, plan
from .state_plans import IS_TEXT, LINES, VERDICT, checked, tokens_of

HAS = lambda n: F.col("doc_id") % n == 0


def metadata(s, d):
    """A metadata document for each talk; some break a rule."""
    title = F.when(HAS(11), " ").otherwise(F.substring("text", 1, 12))
    date = F.when(HAS(13), "12 May").otherwise(F.concat(F.lit("2001-02-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")))
    slug = lambda i: F.when(HAS(19), F.concat(F.lit("-"), i.cast("string"))).when(HAS(7), "Same").otherwise(F.concat(F.lit("Video-"), i.cast("string")))
    video = lambda i: F.struct(slug(i).alias("slug"), F.concat(F.lit("Part "), i.cast("string")).alias("title"), F.lit("ref").alias("video_ref"), F.when(HAS(23), "https://x/1").alias("vimeo_url"))
    videos = F.transform(F.slice(F.sequence(F.lit(1), F.lit(3)), F.lit(1), (F.col("doc_id") % 4).cast("int")), video)
    omit = F.when(HAS(29), F.array(F.lit(""))).when(HAS(2), F.array(F.lit("aside")))
    meta = F.struct(title.alias("title"), date.alias("date"), F.col("source").alias("location"), F.when(HAS(17), "xx").otherwise(F.col("lang")).alias("language"), omit.alias("subtitle_omit"), videos.alias("videos"))
    return V.table(s, d, "documents").select(F.col("doc_id").alias("talk_id"), F.to_json(meta).alias("json"))


TITLE = "case when doc_id % 11 = 0 then ' ' else substr(text, 1, 12) end"
TALKS = f"""tk as (select doc_id talk_id, {TITLE} title, case when doc_id % 13 = 0 then '12 May' else '2001-02-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') end date, source "location", case when doc_id % 17 = 0 then 'xx' else lang end "language" from documents),
    vd as (select doc_id talk_id, (i - 1)::int pos, case when doc_id % 19 = 0 then '-' || i when doc_id % 7 = 0 then 'Same' else 'Video-' || i end slug, 'Part ' || i title, doc_id % 23 = 0 plain from (select doc_id, unnest(range(1, doc_id % 4 + 1)) i from documents))"""
plan("s4_read_talks", "", f"with {TALKS} select * from tk")(lambda s, d: T.parse_talks(metadata(s, d))[0].select("talk_id", "title", "date", "location", "language"))
plan("s4_read_talk_videos", "", f"with {TALKS} select talk_id, pos, slug, title, 'ref' video_ref from vd")(lambda s, d: T.parse_talks(metadata(s, d))[1].drop("vimeo_url"))
CONTRACT = f"""{TALKS}, mc as (select distinct talk_id, unnest(list_filter([case when trim(title) = '' then 'no title' end, case when date = '12 May' then 'bad date' end, case when "language" is null or "language" not in ({', '.join(f"'{x}'" for x in T.LANGUAGES)}) then 'bad language' end,
    case when talk_id % 29 = 0 then 'bad omit list' end], lambda x: x is not null)) violation from tk
    union select talk_id, unnest(list_filter([case when starts_with(slug, '-') then 'bad slug' end, case when n > 1 then 'duplicate slug' end, case when plain then 'plain link' end], lambda x: x is not null)) from (select *, count(*) over (partition by talk_id, slug) n from vd))"""
plan("a16_metadata_contract", "", f"with {CONTRACT} select * from mc")(lambda s, d: T.metadata_contract(*T.parse_talks(metadata(s, d))))
plan("a26_artifact_contracts", "segments timecodes", f"""with {CONTRACT}, al as (select talk_id video_id, 0 rank, 'metadata' artifact, violation from mc union all select video_id, 1, 'speech', violation from (@@A14@@) union all select video_id, 2, 'timecodes', violation from (@@A15@@))
    select video_id, violations, f.artifact artifact, f.violation violation from (select video_id, count(*) violations, min({{'rank': rank, 'violation': violation, 'artifact': artifact}}) f from al group by 1)""".replace("@@A14@@", """with s as (select *, start_ms - seg_id % 4 * 9000 a, max(end_ms) over (partition by video_id order by seg_id rows between unbounded preceding and 1 preceding) reached from segments)
    select video_id, seg_id, unnest(list_filter([case when a < 0 then 'negative start' end, case when end_ms < a then 'end before start' end, case when reached - a > 20000 then 'rewind' end], lambda x: x is not null)) violation from s""").replace("@@A15@@", """with t as (select *, count(*) over (partition by video_id, id) n, lag(id) over v pi, lag(start_ms) over v ps from timecodes window v as (partition by video_id order by id))
    select video_id, id, unnest(list_filter([case when n > 1 then 'duplicate' end, case when id - pi > 1 then 'hole' end, case when start_ms < ps then 'not ascending' end, case when start_ms >= end_ms then 'no length' end], lambda x: x is not null)) violation from t"""))(lambda s, d: contracts(s, d))


def contracts(s, d):
    cues = staged(V.cues(s, d), "cues")
    speech = K.speech_contract(V.segments(cues).withColumn("start_ms", F.col("start_ms") - F.col("seg_id") % 4 * 9000))
    meta = T.metadata_contract(*T.parse_talks(metadata(s, d))).withColumnRenamed("talk_id", "video_id")
    return T.artifact_contracts(meta, speech, K.timecode_contract(V.timecodes(cues)))


def manifest_texts(s, d):
    """Build manifests as text; some values are quoted, some lines are others."""
    m = V.manifests(s, d)
    quote = F.when(F.col("video_id") % 3 == 0, "'").otherwise("")
    return m.select("video_id", F.concat(F.lit("# built\nrole: "), "role", F.lit("\nmode: "), quote, "mode", quote, F.lit("\nrun_id: 7\n")).alias("file"))


plan("s6_read_manifests", "manifests", "select doc_id video_id, coalesce(role, 'strict') role, coalesce(mode, 'strict') as mode from documents left join manifests on video_id = doc_id")(
    lambda s, d: T.build_modes(V.table(s, d, "documents").select(F.col("doc_id").alias("video_id")), T.parse_manifests(manifest_texts(s, d)))
)
plan("k6_write_manifest", "manifests", """select video_id, 'role: secondary' || chr(10) || 'mode: ' || mode || chr(10) || 'primary_slug: Video-' || video_id % 4 || chr(10) || 'built_at: ''2024-05-06T07:08:09Z''' || chr(10) || 'run_id: 42' || chr(10) file from manifests where role = 'secondary'""")(
    lambda s, d: T.manifest_files(V.manifests(s, d).where("role = 'secondary'").withColumn("primary_slug", F.concat(F.lit("Video-"), F.col("video_id") % 4)), "42", F.lit("2024-05-06 07:08:09").cast("timestamp"))
)


def pages_with_videos(s, d):
    """Pages with player boxes (labelled, nested, without a player, never closed), bare players, a script that is never closed, and a language header."""
    k = lambda n: F.col("page_id") % 7 == n
    frame = lambda n: F.concat(F.lit('<iframe src="https://player.vimeo.com/video/'), F.col("page_id") * 10 + n, F.lit('?h=1"></iframe>'))
    box = lambda info, inner: F.concat(F.lit('<div class="embedded-video-wrapper">'), F.lit(info), inner, F.lit("</div>"))
    told = '<div class="video-meta-info">2001-02-03 Evening Talk, Rome, Italy</div>'
    none = F.lit("<div>soon</div>")
    more = (
        F.when(k(0), F.concat(box(told, frame(1)), box(told, frame(2))))
        .when(k(1), box("", frame(1)))
        .when(k(2), F.concat(F.lit("<h3>Morning</h3>"), frame(1), frame(2)))
        .when(k(3), F.concat(box(told, none), box("", F.concat(F.lit("<div><div>"), frame(1), F.lit("</div></div>"))), F.lit("<p>after</p>")))
        .when(k(4), F.concat(F.lit('<div class="embedded-video-wrapper">'), box(told, frame(1)), frame(2)))
        .when(k(5), F.concat(box(told, none), F.lit("<b>Evening</b> "), frame(1), F.lit("<script>var a = 1 < 2;"), frame(2)))
        .otherwise(F.lit(""))
    )
    header = F.when(F.col("page_id") % 3 == 0, "<p>Talk Language: English, Marathi | x</p>").when(F.col("page_id") % 3 == 1, "<p>Talk Language: Dutch</p>").otherwise("")
    return V.table(s, d, "pages").withColumn("html", F.concat("html", header, more))


def planted() -> str:
    """The same pages as SQL; all else is read from their HTML."""
    frame = lambda n: f"""'<iframe src="https://player.vimeo.com/video/' || (page_id * 10 + {n}) || '?h=1"></iframe>'"""
    box = lambda *inner: """'<div class="embedded-video-wrapper">' || """ + " || ".join([*inner, "'</div>'"])
    told, none = """'<div class="video-meta-info">2001-02-03 Evening Talk, Rome, Italy</div>'""", "'<div>soon</div>'"
    return f"""pg as materialized (select page_id, url, html || case page_id % 3 when 0 then '<p>Talk Language: English, Marathi | x</p>' when 1 then '<p>Talk Language: Dutch</p>' else '' end || case page_id % 7
    when 0 then {box(told, frame(1))} || {box(told, frame(2))} when 1 then {box(frame(1))} when 2 then '<h3>Morning</h3>' || {frame(1)} || {frame(2)} when 3 then {box(told, none)} || {box("'<div><div>'", frame(1), "'</div></div>'")} || '<p>after</p>'
    when 4 then '<div class="embedded-video-wrapper">' || {box(told, frame(1))} || {frame(2)} when 5 then {box(told, none)} || '<b>Evening</b> ' || {frame(1)} || '<script>var a = 1 < 2;' || {frame(2)} else '' end html from pages), {tokens_of('pg')}"""


VIDEOS = rf"""{planted()}, vt as (select *, nullif(regexp_extract(tok, '{H.FRAME}', 1), '') video, case when {IS_TEXT} then nullif(trim(translate(tok, chr(13) || chr(10) || chr(9), '   ')), '') end words, regexp_matches(tok, '{H.INFO}') info from tk),
    vn as (select *, lead(words) over (partition by page_id order by ix) told from vt), vf as (select bx.page_id, number, arg_min(video, vt.ix) video from bx join vt on vt.page_id = bx.page_id and vt.ix > bx.ix and vt.ix < bx.till where video is not null group by 1, 2),
    vi as (select bx.page_id, number, arg_min(coalesce(told, ''), vn.ix) told from bx join vn on vn.page_id = bx.page_id and vn.ix > bx.ix and vn.ix < bx.till where info group by 1, 2),
    vb as (select page_id, number, video, trim(string_split(regexp_replace(told, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\s+', ''), ',')[1]) label from vf left join vi using (page_id, number)),
    vs as (select *, lag(tok, 1) over o a, lag(words, 2) over o b, lag(tok, 3) over o c from vt where words is not null or trim(translate(tok, chr(13) || chr(10) || chr(9), '   ')) <> '' window o as (partition by page_id order by ix)),
    vr as (select page_id, row_number() over (partition by page_id order by ix) number, video, case when regexp_full_match(c, '(?i)<(h[1-6]|strong|b|p)>') and lower(a) = '</' || lower(c[2:]) then b end label from vs where video is not null and page_id not in (select page_id from vf)),
    va as (select *, coalesce(nullif(label, ''), 'Video ' || number) title from (select * from vb union all select * from vr)),
    vz as (select *, row_number() over (partition by page_id, title order by number) again, (row_number() over (partition by page_id order by number) - 1)::int pos from va),
    pv as (select page_id, pos, title, replace(title, ' ', '-') || case when again = 1 then '' else '-' || again end slug, 'https://vimeo.com/' || video link from vz),
    la as (select page_id, coalesce(nullif(array_to_string(list_transform(list_filter(list_transform(string_split(regexp_extract(html, 'Talk Language:([^|<\r\n]*)', 1), ','), lambda x: trim(lower(x))), lambda x: x <> ''), lambda x: case x when 'english' then 'en' when 'marathi' then 'mr' else left(x, 2) end), ','), ''), 'en') languages from pg)"""
plan("s14_page_videos", "", f"with {VIDEOS} select * from pv")(lambda s, d: T.page_videos(pages_with_videos(s, d)))
plan("s7_lines_around_players", "", f"with {planted()} select * from {LINES}")(lambda s, d: text_lines(pages_with_videos(s, d)))
plan("a21_declared_languages", "", f"with {VIDEOS} select * from la")(
    lambda s, d: pages_with_videos(s, d).select("page_id", F.array_join(T.declared_languages(F.regexp_replace("html", "<[^>]*>", "\n")), ",").alias("languages"))
)
plan("c10_page_ingest", "", f"""with {VIDEOS}, l as (select page_id doc_id, pos, line from {LINES}), a as (select *, min(pos) over (partition by doc_id, line) < pos again from l), r as (select *, row_number() over (partition by doc_id order by pos) - row_number() over (partition by doc_id, again order by pos) run from a),
    n as (select doc_id, count(*) filter (not (again and size >= 3)) lines from (select *, count(*) over (partition by doc_id, again, run) size from r) group by 1)
    select t.page_id, title, coalesce(lines, 0) lines, languages, coalesce(v, '') videos from ({ORACLES['s8_page_title']}) t left join n on n.doc_id = t.page_id left join la using (page_id) left join (select page_id, string_agg(slug, ',' order by slug) v from pv group by 1) using (page_id)""")(
    lambda s, d: T.ingest(pages_with_videos(s, d))
)


def paths(s, d):
    k = lambda n: F.col("page_id") % 6 == n
    name = F.when(k(0), "transcript_fr.txt").when(k(1), "fr.txt").when(k(2), "v2-fr-final.srt").when(k(3), "en.srt").when(k(4), "notes_fr.txt").otherwise("fr\\source\\fr.srt")
    return V.table(s, d, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 7 == 0, "tests/fixtures/").otherwise("talks/"), "page_id", F.lit("/"), name).alias("path"))


plan("f15_path_class", "", "select page_id, page_id % 6 in (0, 1, 2, 5) is_content, page_id % 7 <> 0 is_scanned from pages")(
    lambda s, d: paths(s, d).select("page_id", T.is_content_path(F.col("path"), "fr").alias("is_content"), T.is_scanned_path(F.col("path")).alias("is_scanned"))
)


def edit_docs(s, d):
    """An edit document for each conversation: blocks, marks, plain and nested edits, mode, markers."""
    c = V.table(s, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 30).alias("t"), F.col("turn").cast("string").alias("k"))
    some = lambda n, v: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("turn") % 4 == n, F.struct(F.col("k").alias("key"), v.alias("value"))))))
    marker = F.struct(F.col("turn").cast("double").alias("time"), F.lit("0").alias("tc"), F.col("t").alias("text"), F.lit("c").alias("comment"))
    agg = c.groupBy("conv_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").alias("key"), F.col("t").alias("value"))))).alias("blocks"), some(0, F.col("t")).alias("marks"), some(1, F.col("t")).alias("plain"),
        some(2, F.to_json(F.create_map(F.lit("7"), F.col("t")))).alias("nested"), F.array_sort(F.collect_list(F.when(F.col("turn") % 4 == 3, marker))).alias("markers"),
    )
    entry = F.struct(F.lit("marker").alias("mode"), "marks", F.map_concat("plain", "nested").alias("edits"), "markers")
    doc = F.create_map(F.lit("srt_edits_a"), F.to_json("blocks"), F.lit("preview_a"), F.to_json(entry))
    return agg.select("conv_id", F.to_json(doc).alias("doc"))


JS = lambda x: f"to_json({x})::varchar"
KEY = lambda *p: "'[' || " + " || ',' || ".join(JS(x) for x in p) + " || ']'"
plan("f20_flatten_json_doc", "", f"""with c as (select conv_id, turn, turn::varchar k, substr(text, 1, 30) t from conversations)
    select conv_id, {KEY("'srt_edits_a'", "'blocks'", 'k')} path, {JS('t')} leaf from c union all select conv_id, {KEY("'preview_a'", "'marks'", 'k')}, {JS('t')} from c where turn % 4 = 0 union all select conv_id, {KEY("'preview_a'", "'edits'", 'k')}, {JS('t')} from c where turn % 4 = 1
    union all select conv_id, {KEY("'preview_a'", "'edits'", 'k', "'7'")}, {JS('t')} from c where turn % 4 = 2 union all select distinct conv_id, {KEY("'preview_a'", "'mode'")}, '"marker"' from c
    union all select conv_id, {KEY("'preview_a'", "'markers'", "turn::double::varchar || '|' || t")}, '{{"time":' || turn::double::varchar || ',"tc":"0","text":' || {JS('t')} || ',"comment":"c"}}' from c where turn % 4 = 3""")(
    lambda s, d: T.flatten_doc(edit_docs(s, d))
)


def talk_files(s, d) -> str:
    """A tree of cue files in the shared folder, talks/<talk>/<video>/<source or final>/<name>; some of its 30 videos lack one of the two."""
    files = staged(Q.cue_files(V.cues(s, d)).select((F.col("video_id") % 10).alias("talk"), (F.col("video_id") % 30).alias("video"), F.col("file").alias("value")), "talk-files")
    root = f"{shared_dir(s)}/talk-files/{uuid.uuid4().hex}"
    for folder, lacking in (("final", 3), ("source", 4)):
        rows = files.where(F.col("video") % 5 != lacking).repartition("talk", "video")
        rows.select("value", "talk", "video", F.lit(folder).alias("folder")).write.mode("append").partitionBy("talk", "video", "folder").text(f"{root}/talks", lineSep="\x00")
    return root


plan("s11_discover_artifacts", "", "select distinct 'talk=' || doc_id % 10 talk_id, 'video=' || doc_id % 30 video_slug from documents where doc_id % 5 not in (3, 4) and trim(text) <> ''")(
    lambda s, d: S.discover(s, f"{talk_files(s, d)}/talks/*/*/*/*.txt")
)


def incremental(s, d):
    """The newest verdicts of every third video: all come as changed files, half of them once more after a bad version, a few files a batch."""
    root = f"{shared_dir(s)}/changed/{uuid.uuid4().hex}"
    cues = V.cues(s, d).where("video_id % 3 = 0").select("video_id", "idx", "text", "start_ms", "end_ms")
    bad = cues.withColumn("end_ms", F.when(F.col("video_id") % 6 == 0, F.col("end_ms") + 9000).otherwise(F.col("end_ms")))

    def check(batch):
        touched = staged(batch, "touched")
        paragraphs = V.paragraphs(s, d).join(touched.select("video_id").distinct(), "video_id", "left_semi")
        return checked(s, d, touched, paragraphs)

    for version in (bad, cues.where("video_id % 6 = 0")):
        version.repartition(4, "video_id").write.mode("append").parquet(f"{root}/in")
        J.on_changed(J.changed_files(s, f"{root}/in", cues.schema, 3), check, f"{root}/out", f"{root}/progress").awaitTermination()
    return J.newest_verdicts(s, f"{root}/out")


plan("x4_incremental_validation", "paragraphs cues edited_cues cues_b manifests", VERDICT + ' select *, "text" and overlap and "time" and numbering and cpl and gap and block_ratio and duration and cps passed from v where video_id % 3 = 0')(incremental)
