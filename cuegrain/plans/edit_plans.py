"""Plans on text edits, block splitting, contracts and reports of talks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as T
from ..operators import align as A
from ..operators import cues as C
from ..operators import edits as E
from ..operators import packed as P
from ..operators import quality as Q
from ..operators import talks as Z
from ..operators import validate as K
from ..staging import staged
from .cue_plans import LEAD, STATS, V_
from .registry import plan
from .state_plans import FIELD, dirty, typo

plan("j13_strip_phrases", "cues", """select video_id, idx, cut <> text touched, case when cut <> text then trim(regexp_replace(cut, ' {2,}', ' ', 'g')) else text end as text from (select *, regexp_replace(text, '(?i)the thin|thand|er', '', 'g') cut from cues)""")(
    lambda s, d: E.strip_phrases(V.cues(s, d).select("video_id", "idx", "text"), ["er", "the thin", "Thand"])
)


def edited_paragraphs(s, d):
    """The paragraphs after an edit; some videos lose their last one."""
    p = V.paragraphs(s, d)
    last = F.max("para_idx").over(Window.partitionBy("video_id"))
    kept = p.withColumn("m", last).where(~((F.col("video_id") % 10 == 3) & (F.col("para_idx") == F.col("m")))).drop("m")
    text = F.when((F.col("para_idx") % 4 == 1) & (F.length("text") > 9), F.concat(F.substring("text", 1, 4), F.lit("Q"), F.expr("substring(text, 6)"))).when(F.col("para_idx") % 4 == 2, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    return kept.withColumn("text", text)


EDITED = """ep as (select video_id, para_idx, case when para_idx % 4 = 1 and length(text) > 9 then substr(text, 1, 4) || 'Q' || substr(text, 6) when para_idx % 4 = 2 then text || ' more' else text end as text
    from (select *, max(para_idx) over (partition by video_id) m from paragraphs) where not (video_id % 10 = 3 and para_idx = m)),
    ct as (select video_id, a, b from (select video_id, count(*) a from paragraphs group by 1) join (select video_id, count(*) b from ep group by 1) using (video_id)),
    df as (select p.video_id, p.para_idx, p.text o, e.text n from paragraphs p join ep e on e.video_id = p.video_id and e.para_idx = p.para_idx join ct on ct.video_id = p.video_id where a = b and p.text <> e.text)"""
plan("j17_paragraph_diff", "paragraphs", f"with {EDITED} select video_id, para_idx, o old, n \"new\", null::varchar problem from df union all select video_id, null, null, null, 'count' from ct where a <> b")(lambda s, d: E.paragraph_diff(V.paragraphs(s, d), edited_paragraphs(s, d)))
FRAGMENT = f"""with {EDITED}, x as (select *, least(length(o), length(n)) m from df), p as (select *, coalesce(list_position(list_transform(range(1, m + 1), lambda i: o[i] = n[i]), false) - 1, m) p from x),
    q as (select *, case when m = p then 0 else coalesce(list_position(list_transform(range(1, m - p + 1), lambda i: o[length(o) - i + 1] = n[length(n) - i + 1]), false) - 1, m - p) end s from p),
    k as (select *, coalesce(list_filter([0, 1, 2, 3], lambda k: length(o) - p - s + least(k, p) + least(k, s) >= 3)[1], 3) k from q), f as (select *, p - least(k, p) p2, s - least(k, s) s2 from k)
    select video_id, para_idx, substr(o, p2 + 1, length(o) - p2 - s2) old_part, substr(n, p2 + 1, length(n) - p2 - s2) new_part, p2::int "at" from f"""
plan("j18_minimal_edit_fragment", "paragraphs", FRAGMENT)(lambda s, d: fragments(s, d))


def fragments(s, d):
    changed = E.paragraph_diff(V.paragraphs(s, d), edited_paragraphs(s, d)).where("problem is null")
    return changed.select("video_id", "para_idx", E.minimal_fragment(F.col("old"), F.col("new")).alias("f")).select("video_id", "para_idx", "f.*")


plan("j26_block_run_in_cues", "cues", """with b as (select video_id, idx // 3 list_id, (row_number() over (partition by video_id, idx // 3 order by idx))::int id, text from (select * replace (case when idx % 50 = 29 then text || ' -' else text end as text) from cues)), n as (select list_id, video_id, count(*) n from b group by all),
    h as (select list_id, b.video_id, idx - id shift, count(*) c, min(idx) first_idx from b join cues c on c.video_id = b.video_id and c.text = b.text group by all) select list_id, video_id, min(first_idx) first_idx from h join n using (list_id, video_id) where c = n group by all""")(
    lambda s, d: E.block_runs(some_blocks(s, d), V.cues(s, d))
)


def some_blocks(s, d):
    """Lists of three neighbouring cues, all of them; one cue in fifty is edited, so its list is found nowhere."""
    text = F.when(F.col("idx") % 50 == 29, F.concat("text", F.lit(" -"))).otherwise(F.col("text"))
    c = V.cues(s, d).withColumn("list_id", F.expr("idx div 3")).withColumn("text", text)
    return c.select("video_id", "list_id", F.row_number().over(Window.partitionBy("video_id", "list_id").orderBy("idx")).alias("id"), "text")


NW = r"regexp_replace(lower(x), '[^\p{L}\p{N}_]+', '', 'g')"
GRAMS = f"(select video_id, idx, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) g from (select *, list_transform(string_split(text, ' '), lambda x: {NW}) w from @@))"
plan("j14_similar_block_match", "cues edited_cues", f"""with a as materialized (select video_id, idx old, len(g) n_old, unnest(g) g from {GRAMS.replace('@@', 'cues')}), b as materialized (select video_id, idx "new", len(g) n_new, unnest(g) g from {GRAMS.replace('@@', 'edited_cues')}),
    p as (select a.video_id, old, "new", count(*) * 100 // (any_value(n_old) + any_value(n_new) - count(*)) score from a join b on a.video_id = b.video_id and a.g = b.g group by 1, 2, 3 having score > 50),
    r as (select *, row_number() over (partition by video_id, old order by score desc, "new") x, row_number() over (partition by video_id, "new" order by score desc, old) y from p) select video_id, old, "new", score from r where x = 1 and y = 1""")(
    lambda s, d: E.similar_blocks(V.cues(s, d), V.edited_cues(V.cues(s, d)))
)
PAUSE = "pz as (select video_id, ends r_start, ends + pause_ms r_end from (select video_id, end_ms ends, lead(start_ms) over (partition by video_id order by cue_idx, w_pos) - end_ms pause_ms from words) where pause_ms >= 120)"


def pause_spans(s, d):
    return A.pauses(V.spoken(V.cues(s, d))).select("video_id", F.col("ends").alias("r_start"), (F.col("ends") + F.col("pause_ms")).alias("r_end"))


plan("w28_split_span_by_pauses", "segments words", f"""with {PAUSE}, i as (select g.video_id, seg_id idx, r_start, r_end, row_number() over (partition by g.video_id, seg_id order by r_end - r_start desc, r_start) r from segments g join pz on pz.video_id = g.video_id and g.start_ms + 200 <= r_start and r_end <= g.end_ms - 200 and r_end > g.start_ms and r_start < g.end_ms),
    c as (select video_id, idx, list({{'a': r_start, 'z': r_end}} order by r_start) c from i where r < 3 group by 1, 2), j as (select g.video_id, seg_id idx, start_ms s, end_ms e, coalesce(len(c) = 2, false) bp, c from segments g left join c on c.video_id = g.video_id and c.idx = g.seg_id),
    k as (select *, case when bp then c else [{{'a': s + (e - s) // 3, 'z': s + (e - s) // 3}}, {{'a': s + (e - s) // 3 * 2, 'z': s + (e - s) // 3 * 2}}] end cc from j), p as (select *, unnest([0, 1, 2]) part from k)
    select video_id, idx, part, case part when 0 then s else cc[part].z end a_ms, case part when 2 then e else cc[part + 1].a end z_ms, bp by_pause from p""")(
    lambda s, d: E.split_spans(V.segments(V.cues(s, d)).select("video_id", F.col("seg_id").alias("idx"), "start_ms", "end_ms"), pause_spans(s, d))
)
plan("w29_snap_to_speech_gap", "segments words", f"""with {PAUSE}, m as (select video_id, (r_start + r_end) // 2 mid, r_end - r_start size from pz where r_end - r_start > 200), t as (select video_id, seg_id idx, (start_ms + end_ms) // 2 t from segments),
    h as (select t.video_id, idx, mid, row_number() over (partition by t.video_id, idx order by abs(mid - t) * 5 - size, mid) r from t join m on m.video_id = t.video_id and abs(mid - t) < 3000) select t.video_id, t.idx, t, coalesce(mid, t) snapped from t left join (select * from h where r = 1) h on h.video_id = t.video_id and h.idx = t.idx""")(
    lambda s, d: E.snap_to_pause(V.segments(V.cues(s, d)).select("video_id", F.col("seg_id").alias("idx"), F.expr("(start_ms + end_ms) div 2").alias("t")), pause_spans(s, d))
)
LIST = lambda ws: ", ".join(f"'{w}'" for w in ws)
BLOCKS = f"""recursive cut as (select video_id, para_idx, s_idx::bigint s_idx, [0] path, text from sentences union all
    select video_id, para_idx, s_idx, list_append(path, side), case side when 0 then substr(text, 1, pos) else substr(text, pos + 2) end from (
    select *, list_min(list_transform(range(1, len(w)), lambda i: {{'wide': (not (e[i] <= 84 and length(text) - e[i] - 1 <= 84))::int, 'rank': case when not (e[i] <= 84 and length(text) - e[i] - 1 <= 84) then 0 when regexp_matches(w[i], '[.!?]$') then 0 when regexp_matches(w[i], '[,;:—]$') then 1
    when regexp_replace(lower(w[i + 1]), '[.,;:!?]+$', '') in ({LIST(E.CONJUNCTIONS)}) then 2 when regexp_replace(lower(w[i + 1]), '[.,;:!?]+$', '') in ({LIST(E.PREPOSITIONS)}) then 3 else 4 end, 'off': abs(2 * e[i] - length(text)), 'at': e[i]}}))['at'] pos, unnest([0, 1]) side from (
    select *, string_split(text, ' ') w, list_transform(range(1, len(string_split(text, ' ')) + 1), lambda i: length(array_to_string(string_split(text, ' ')[1:i], ' '))) e from cut where length(text) > 84 and contains(text, ' ')))),
    bl as (select video_id, (row_number() over (partition by video_id order by para_idx, s_idx, path))::int id, para_idx, text from cut where length(text) <= 84 or not contains(text, ' '))"""


plan("w31_blocks_from_paragraphs", "sentences", "with " + BLOCKS + " select * from bl")(lambda s, d: E.blocks(V.paragraphs(s, d)))
plan("f9_split_to_width", "paragraphs", "with " + BLOCKS.replace("select video_id, para_idx, s_idx::bigint s_idx, [0] path, text from sentences", "select video_id, para_idx, 0::bigint s_idx, [0] path, text from paragraphs") + " select video_id, para_idx, (row_number() over (partition by video_id, para_idx order by id) - 1)::int i, text part from bl")(lambda s, d: V.paragraphs(s, d).select("video_id", "para_idx", F.posexplode(E.split_to_width(F.col("text"))).alias("i", "part")))


def built(s, d):
    """Blocks with timecodes, gaps enforced, padded into silence and trimmed."""
    blocks = V.cues(s, d).select("video_id", "idx", "text")
    good, _ = A.assemble(blocks, V.timecodes(V.cues(s, d)))
    return C.trim_overlaps(C.pad_into_silence(C.enforce_gaps(good).drop("gap_class")))


ENDS = {
    "gaps": f"case when {LEAD} is null or {LEAD} - end_ms >= 80 or {LEAD} - 80 <= start_ms then end_ms else {LEAD} - 80 end",
    "pad": f"case when {LEAD} is null then greatest(end_ms, least(end_ms + 2000, start_ms + 21000)) else greatest(end_ms, least({LEAD} - 80, end_ms + 5000, start_ms + 21000)) end",
    "trim": f"case when {LEAD} - end_ms < 80 then {LEAD} - 80 else end_ms end",
}
plan("c2_build_cues", "cues timecodes", f"""with b as (select c.video_id, c.idx, text, t.start_ms, t.end_ms from cues c join timecodes t on t.video_id = c.video_id and t.id = c.idx where t.start_ms < t.end_ms),
    g as (select * replace ({ENDS['gaps']} as end_ms) from b {V_}), p as (select * replace ({ENDS['pad']} as end_ms) from g {V_}), w as (select * replace ({ENDS['trim']} as end_ms) from p {V_}) {STATS.format(t='w')}""")(lambda s, d: Q.video_stats(built(s, d)))
plan("t3_first_n_violations", "timecodes", """with t as (select *, lag(id) over (partition by video_id order by id) pi from timecodes), b as (select video_id, id idx from t where id - pi > 1) select video_id, idx, total from (select *, row_number() over (partition by video_id order by idx) n, count(*) over (partition by video_id) total from b) where n <= 3""")(
    lambda s, d: Q.first_violations(K.timecode_contract(V.timecodes(V.cues(s, d))).where("violation = 'hole'").select("video_id", F.col("id").alias("idx")), 3)
)
CHANGED = f"""with {EDITED}, c as (select distinct video_id from (select video_id, idx, text from cues except select video_id, idx, text from edited_cues))
    select coalesce(c.video_id, p.video_id) video_id, c.video_id is not null cues_edited, p.video_id is not null transcript_edited from c full join (select distinct video_id from (select video_id from df union all select video_id from ct where a <> b)) p using (video_id)"""
plan("a11_changed_talks", "cues edited_cues paragraphs", CHANGED)(lambda s, d: changed(s, d))


def changed(s, d, cues=None, edits=None):
    """Videos with edited cues, edited transcripts or both: a union of the two change sets. `edits` has rows for the edited transcripts, if they are known."""
    cues = staged(V.cues(s, d), "cues") if cues is None else cues
    c = E.edited_videos(cues, V.edited_cues(cues)).select("video_id", F.lit(True).alias("c"), F.lit(False).alias("t"))
    edits = E.paragraph_diff(V.paragraphs(s, d), edited_paragraphs(s, d)) if edits is None else edits
    t = edits.select("video_id", F.lit(False).alias("c"), F.lit(True).alias("t"))
    return c.unionByName(t).groupBy("video_id").agg(F.bool_or("c").alias("cues_edited"), F.bool_or("t").alias("transcript_edited"))


plan("u2_talks_touched", "cues edited_cues paragraphs", f"""with {EDITED} select video_id from (select video_id, idx, text from cues except select video_id, idx, text from edited_cues) union select video_id from df union select video_id from ct where a <> b""")(lambda s, d: changed(s, d).select("video_id"))
plan("a25_text_unchanged", "cues edited_cues", """with a as (select video_id, string_agg(text, ' ' order by idx) t from cues group by 1), b as (select video_id, string_agg(text, ' ' order by idx) t from edited_cues group by 1)
    select video_id, trim(a.t) is not distinct from trim(b.t) unchanged, length(a.t) old_length, length(b.t) new_length from a left join b using (video_id)""")(lambda s, d: unchanged(s, d))


def unchanged(s, d):
    whole = lambda c, n: Q._ordered(c, "idx", F.col("text"), " ", n)
    j = whole(V.cues(s, d), "a").join(whole(V.edited_cues(V.cues(s, d)), "b"), "video_id", "left")
    return j.select("video_id", F.trim("a").eqNullSafe(F.trim("b")).alias("unchanged"), F.length("a").cast("long").alias("old_length"), F.length("b").cast("long").alias("new_length"))


plan("a17_word_alignment_contract", "cues words", """with w as (select video_id, cue_idx idx, string_agg(word, ' ' order by w_pos) t, min(start_ms) a, max(end_ms) z, bool_or(back) back from (select *, start_ms < lag(start_ms) over (partition by video_id, cue_idx order by w_pos) back from words) group by 1, 2)
    select c.video_id, c.idx, w.t is null missing, coalesce(w.t <> c.text, false) text_differs, coalesce(a < c.start_ms - 100 or z > c.end_ms + 100, false) outside, coalesce(back, false) back from cues c left join w using (video_id, idx)""")(
    lambda s, d: alignment(s, d)
)


def alignment(s, d):
    def heard(ws):
        back = lambda h, i: (i > 0) & (h["start_ms"] < F.get(ws, i - 1)["start_ms"])
        of = lambda field: F.transform(ws, lambda h: h[field])
        return F.struct(ws[0]["cue_idx"].alias("idx"), F.array_join(of("word"), " ").alias("t"), F.array_min(of("start_ms")).alias("a"), F.array_max(of("end_ms")).alias("z"), F.exists(F.transform(ws, back), lambda x: x).alias("b"))

    rows = V.spoken(V.cues(s, d)).select("video_id", F.explode_outer(F.transform(P.runs(F.col("heard"), lambda h: h["cue_idx"]), heard)).alias("x"))
    by = rows.where("x is not null").select("video_id", "x.*")
    j = V.cues(s, d).join(by, ["video_id", "idx"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.select("video_id", "idx", F.col("t").isNull().alias("missing"), no(F.col("t") != F.col("text")).alias("text_differs"), no((F.col("a") < F.col("start_ms") - 100) | (F.col("z") > F.col("end_ms") + 100)).alias("outside"), no(F.col("b")).alias("back"))


plan("a18_fetch_ledger", "", """select source slug, case when e and f then 'complete' when e or f then 'partial' else 'missing' end state, tiny from (select source, bool_or(lang = 'en' and doc_id % 3 = 0) e, bool_or(lang = 'fr' and doc_id % 3 = 0) f, count(*) filter (length(text) < 200) tiny from documents group by 1)""")(lambda s, d: ledger(s, d))


def ledger(s, d):
    have = lambda lang: F.bool_or((F.col("lang") == lang) & (F.col("doc_id") % 3 == 0))
    g = V.table(s, d, "documents").groupBy(F.col("source").alias("slug")).agg(have("en").alias("e"), have("fr").alias("f"), F.count_if(F.length("text") < 200).alias("tiny"))
    return g.select("slug", F.when(F.col("e") & F.col("f"), "complete").when(F.col("e") | F.col("f"), "partial").otherwise("missing").alias("state"), "tiny")


plan("a22_step_progress", "", """with w as (select * from (values ('view', 5), ('click', 20), ('purchase', 70), ('signup', 5)) t(step, weight)), e as (select user_id, event_type step, max(ts) ts, bool_or(value < 1) failed from events group by 1, 2)
    select user_id, sum(case when not failed then weight else 0 end)::bigint done, min(case when failed then e.step end) failed_step, arg_max(e.step, e.ts) current_step from e join w using (step) group by 1""")(lambda s, d: steps(s, d))


def steps(s, d):
    """Weights of a user's completed steps, the failed one, the current one; events outside the table are runner steps."""
    weights = s.createDataFrame([("view", 5), ("click", 20), ("purchase", 70), ("signup", 5)], "step string, weight int")
    e = V.table(s, d, "events").groupBy("user_id", F.col("event_type").alias("step")).agg(F.max("ts").alias("ts"), F.bool_or(F.col("value") < 1).alias("failed")).join(F.broadcast(weights), "step")
    return e.groupBy("user_id").agg(F.sum(F.when(~F.col("failed"), F.col("weight")).otherwise(0)).alias("done"), F.min(F.when(F.col("failed"), F.col("step"))).alias("failed_step"), F.max_by("step", "ts").alias("current_step"))


plan("p10_talk_actions", "cues manifests", """select doc_id video_id, c.video_id is not null and m.video_id is not null preview, lang in ('en', 'fr') review from documents left join (select distinct video_id from cues where video_id % 6 <> 0) c on c.video_id = doc_id left join manifests m on m.video_id = doc_id""")(
    lambda s, d: V.table(s, d, "documents").select(F.col("doc_id").alias("video_id"), F.col("lang").isin("en", "fr").alias("review"))
    .join(V.cues(s, d).where("video_id % 6 <> 0").select("video_id").distinct().withColumn("c", F.lit(True)), "video_id", "left").join(V.manifests(s, d).select("video_id", F.lit(True).alias("m")), "video_id", "left")
    .select("video_id", (F.col("c").isNotNull() & F.col("m").isNotNull()).alias("preview"), "review")
)
plan("p9_catalog_filter", "issues", """select doc_id, source, status from documents left join (select talk_id, arg_max(status, {'t': updated_at, 'n': number}) status from issues where status is not null group by 1) on talk_id = doc_id where contains(lower(text), 'ther') and coalesce(status, 'none') = 'pending'""")(lambda s, d: catalog(s, d, "ther", "pending"))


def catalog(s, d, search: str, status: str):
    """Talks whose text holds the search and whose latest status is the one asked; an unknown filter means all."""
    newest = V.issues(s, d).where("status is not null").groupBy(F.col("talk_id").alias("doc_id")).agg(F.max_by("status", F.struct("updated_at", "number")).alias("status"))
    rows = V.table(s, d, "documents").where(F.contains(F.lower("text"), F.lit(search.lower()))).join(newest, "doc_id", "left")
    if status in ("pending", "in-progress", "approved", "none"):
        rows = rows.where(F.coalesce("status", F.lit("none")) == status)
    return rows.select("doc_id", "source", "status")


plan("k7_export_marker_table", "", r"""select conv_id, string_agg('| ' || turn || ' | ' || replace(replace(replace(replace(text, '\', '\\'), '|', '\|'), chr(10), ' '), '<', '&lt;') || ' |', chr(10) order by turn) file from conversations group by 1""")(lambda s, d: marker_tables(s, d))


def marker_tables(s, d):
    cell = F.col("text")
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\n", " "), ("<", "&lt;")):
        cell = F.replace(cell, F.lit(a), F.lit(b))
    rows = V.table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("| "), "turn", F.lit(" | "), cell, F.lit(" |")).alias("l"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda x: x["l"]), "\n").alias("file"))


plan("k4_export_timing", "words", "select video_id, '[' || string_agg('{' || chr(34) || 'w' || chr(34) || ':' || to_json(word)::varchar || ',' || chr(34) || 's' || chr(34) || ':' || start_ms || ',' || chr(34) || 'e' || chr(34) || ':' || end_ms || '}', ',' order by cue_idx, w_pos) || ']' timing from words group by 1")(lambda s, d: timing(s, d))


def timing(s, d):
    made = F.transform("heard", lambda x: F.struct(x["word"].alias("w"), x["start_ms"].alias("s"), x["end_ms"].alias("e")))
    return V.spoken(V.cues(s, d)).where("size(heard) > 0").select("video_id", F.to_json(made).alias("timing"))


plan("f14_clean_edited", "", f"select doc_id, case when lang = 'en' then {typo(FIELD)} else {FIELD} end as text from documents")(lambda s, d: dirty(s, d).select("doc_id", T.clean_edited(F.col("text"), F.col("lang") == "en").alias("text")))
#: Values made of pages' addresses, right and wrong ones by what the address ends in.
NAMES = r"""(select page_id, case page_id % 4 when 0 then '2001-02-03_' || slug when 1 then '2001-2-3_' || slug when 2 then '2001-02-03_' || slug || ' ' else '2001-02-03_' end talk, case page_id % 3 when 0 then slug when 1 then '-' || slug else slug || chr(10) end slug,
    case page_id % 6 when 0 then 'sync/user/' || slug when 1 then 'sync//' || slug when 2 then slug || '/' when 3 then '../' || slug when 4 then 'v1.2-' || slug else '-' || slug end ref,
    case page_id % 5 when 0 then 'https://vimeo.com/' || page_id when 1 then 'https://player.vimeo.com/video/' || page_id || '/0a1b' when 2 then 'http://vimeo.com/' || page_id when 3 then url else 'https://www.vimeo.com/' || page_id || '/' end link
    from (select page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/?$', 1) slug from pages))"""


def names(s, d):
    """NAMES, as a DataFrame."""
    slug = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]+)/?$", 1)
    p = V.table(s, d, "pages").select("page_id", "url", slug.alias("slug"))
    pick = lambda n, *made: F.element_at(F.array(*made), (F.col("page_id") % n).cast("int") + 1)
    c, t = F.concat, F.lit
    return p.select(
        "page_id",
        pick(4, c(t("2001-02-03_"), "slug"), c(t("2001-2-3_"), "slug"), c(t("2001-02-03_"), "slug", t(" ")), t("2001-02-03_")).alias("talk"),
        pick(3, F.col("slug"), c(t("-"), "slug"), c("slug", t("\n"))).alias("slug"),
        pick(6, c(t("sync/user/"), "slug"), c(t("sync//"), "slug"), c("slug", t("/")), c(t("../"), "slug"), c(t("v1.2-"), "slug"), c(t("-"), "slug")).alias("ref"),
        pick(5, c(t("https://vimeo.com/"), "page_id"), c(t("https://player.vimeo.com/video/"), "page_id", t("/0a1b")), c(t("http://vimeo.com/"), "page_id"), F.col("url"), c(t("https://www.vimeo.com/"), "page_id", t("/"))).alias("link"),
    )


plan("f16_validate_ids", "", rf"""select page_id, regexp_full_match(talk, '\d\d\d\d-\d\d-\d\d_[\w.-]{{1,80}}') talk_id, regexp_full_match(slug, '\w[\w.-]{{0,63}}') slug,
    regexp_full_match(ref, '\w[\w./-]{{0,254}}') and not regexp_matches(ref, '[.][.]|//|/$') ref, regexp_full_match(link, 'https://(www\.)?(vimeo\.com|player\.vimeo\.com/video)/\d+(/[0-9a-f]+)?/?') link from {NAMES}""")(
    lambda s, d: names(s, d).select("page_id", Z.valid_talk_id(F.col("talk")).alias("talk_id"), Z.valid_slug(F.col("slug")).alias("slug"), Z.valid_ref(F.col("ref")).alias("ref"), Z.valid_link(F.col("link")).alias("link"))
)
