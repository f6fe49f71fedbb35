"""Plans on cues: measures, filters, timing windows, per-video aggregates, sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as T
from ..operators import cues as C
from ..operators import quality as Q
from .registry import plan

EXPR = {
    "chars": "length(replace(text, chr(10), ''))",
    "cpl": "list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))",
}
EXPR["cps100"] = f"case when end_ms > start_ms then {EXPR['chars']} * 100000 // (end_ms - start_ms) else 99900 end"
LEAD, LAG = "lead(start_ms) over v", "lag(end_ms) over v"
V_ = "window v as (partition by video_id order by idx)"

plan("p1_cue_measures", "cues", f"select video_id, idx, {EXPR['chars']} chars, len(string_split(text, chr(10)))::int n_lines, {EXPR['cpl']}::int max_cpl, end_ms - start_ms dur_ms, ({EXPR['cps100']})::bigint cps100 from cues")(
    lambda s, d: C.measures(V.cues(s, d)).select("video_id", "idx", "chars", "n_lines", "max_cpl", "dur_ms", "cps100")
)
plan("p2_cue_flags", "cues", f"""select video_id, idx, {EXPR['chars']} * 1000 > 15 * (end_ms - start_ms) over_target, {EXPR['chars']} * 1000 > 20 * (end_ms - start_ms) over_hard, {EXPR['cpl']} > 84 over_cpl,
    end_ms - start_ms < 1200 too_short, end_ms - start_ms > 21000 too_long, len(string_split(text, chr(10))) > 1 over_lines, {EXPR['chars']} > 84 over_chars from cues""")(
    lambda s, d: C.flags(V.cues(s, d)).select("video_id", "idx", "over_target", "over_hard", "over_cpl", "too_short", "too_long", "over_lines", "over_chars")
)
plan("p3_drop_hallucinations", "segments", """select video_id, (row_number() over (partition by video_id order by seg_id) - 1)::int seg_id, start_ms, end_ms from
    (select *, case when seg_id % 7 = 3 then '... ' when seg_id % 11 = 5 then '' else 'speech' end as text from segments) where not regexp_matches(text, '^[.… ]*$')""")(
    lambda s, d: C.drop_hallucinations(V.segments(V.cues(s, d)).withColumn("text", F.when(F.col("seg_id") % 7 == 3, "... ").when(F.col("seg_id") % 11 == 5, "").otherwise("speech"))).select("video_id", "seg_id", "start_ms", "end_ms")
)
plan("p4_drop_stage_lines", "paragraphs", r"""select video_id, para_idx, t text from (select *, case when para_idx % 5 = 2 then '[' || replace(text, ']', '') || ']' else text end t from paragraphs) where not regexp_matches(t, '^\[[^\[\]]+\]$')""")(
    lambda s, d: C.drop_stage_lines(V.paragraphs(s, d).withColumn("text", F.when(F.col("para_idx") % 5 == 2, F.concat(F.lit("["), F.translate("text", "]", ""), F.lit("]"))).otherwise(F.col("text"))))
)
plan("p5_fix_structural_text", "cues", """with t as (select video_id, idx, case when idx % 3 = 0 then ' ' || replace(text, ', ', ',  ') when idx % 3 = 1 then replace(text, '. ', ' ' || chr(10) || ' ') else text end t from cues),
    u as (select *, regexp_replace(t, ' {2,}', ' ', 'g') u from t), w as (select *, array_to_string(list_transform(string_split(u, chr(10)), lambda x: trim(x)), chr(10)) w from u)
    select video_id, idx, w as text, u <> t spaces_fixed, w <> u lines_trimmed from w""")(
    lambda s, d: C.fix_structural_text(V.cues(s, d).withColumn("text", F.when(F.col("idx") % 3 == 0, F.concat(F.lit(" "), F.replace("text", F.lit(", "), F.lit(",  ")))).when(F.col("idx") % 3 == 1, F.replace("text", F.lit(". "), F.lit(" \n "))).otherwise(F.col("text"))))
)
plan("p6_join_lines", "", r"select doc_id, regexp_replace(text, '\s*\n\s*', ' ', 'g') as text, regexp_replace(text, '\s*\n\s*', ' ', 'g') <> text changed from documents")(
    lambda s, d: C.join_lines(V.table(s, d, "documents").select("doc_id", "text"))
)
plan("p7_shift_timeline", "cues", """select video_id, (row_number() over (partition by video_id order by idx))::int idx, text, greatest(0, start_ms + o) start_ms, end_ms + o end_ms from
    (select c.*, (c.video_id % 9 - 5) * 1500 o from cues c) where end_ms + o > 0""")(
    lambda s, d: C.shift_timeline(V.cues(s, d), V.table(s, d, "documents").select(F.col("doc_id").alias("video_id"), ((F.col("doc_id") % 9 - 5) * 1500).alias("offset_ms")))
)
plan("p8_range_select", "cues", "select video_id, idx, text from cues where idx between 1 and 5")(lambda s, d: C.range_select(V.cues(s, d), -3, 5).select("video_id", "idx", "text"))
plan("p8_text_search", "cues", "select video_id, idx, text from cues where contains(lower(text), 'thand')")(lambda s, d: C.text_search(V.cues(s, d), "Thand").select("video_id", "idx", "text"))
plan("p11_frame_gap_class", "cues", f"select video_id, idx, case when g < 125 then 'none' when g <= 458 then 'chain' else 'large' end gap_class from (select *, start_ms - {LAG} g from cues {V_}) where g is not null")(
    lambda s, d: C.with_gaps(V.cues(s, d)).where("gap_ms is not null").select("video_id", "idx", C.gap_class(F.col("gap_ms")).alias("gap_class"))
)
plan("w1_cue_gaps", "cues", f"select video_id, idx, start_ms - {LAG} gap_ms from cues {V_}")(lambda s, d: C.with_gaps(V.cues(s, d)).select("video_id", "idx", "gap_ms"))


def ends(name: str, fn, sql_end: str) -> None:
    """A repair that moves ends only: the twin names the new end."""
    plan(name, "cues", f"select video_id, idx, start_ms, ({sql_end})::bigint end_ms from cues {V_}")(lambda s, d, f=fn: f(V.cues(s, d)).select("video_id", "idx", "start_ms", "end_ms"))


ends("w2_trim_overlaps", C.trim_overlaps, f"case when {LEAD} - end_ms < 80 then {LEAD} - 80 else end_ms end")
ends("w3_structural_gap_fix", C.structural_gap_fix, f"case when {LEAD} < end_ms or ({LEAD} > end_ms and {LEAD} - end_ms < 80) then {LEAD} - 80 else end_ms end")
ends("w5_pad_into_silence", C.pad_into_silence, f"case when {LEAD} is null then greatest(end_ms, least(end_ms + 2000, start_ms + 21000)) else greatest(end_ms, least({LEAD} - 80, end_ms + 5000, start_ms + 21000)) end")
ends("w6_chain_gaps", C.chain_gaps, f"case when {LEAD} - end_ms between 125 and 458 and {LEAD} - 80 - start_ms <= 22000 then {LEAD} - 80 else end_ms end")
ends("w26_snap_trim", C.snap_trim, f"case when {LEAD} - end_ms < 80 then greatest(start_ms, least(end_ms, {LEAD} - 80)) else end_ms end")
ends("w27_min_duration_floor", C.min_duration_floor, f"case when end_ms - start_ms < 1200 then greatest(end_ms, least(start_ms + 1200, greatest(end_ms, coalesce({LEAD} - 80, start_ms + 1200)))) else end_ms end")
plan("w4_enforce_gaps", "cues", f"""with c as (select *, {LEAD} - end_ms d, {LEAD} - 80 t from cues {V_}), k as (select *, case when d is null or d >= 80 then 'ok' when t <= start_ms then 'forced' when d < -2000 then 'large_overlap' else 'trimmed' end gap_class from c)
    select video_id, idx, start_ms, case when gap_class in ('trimmed', 'large_overlap') then t else end_ms end end_ms, gap_class from k""")(
    lambda s, d: C.enforce_gaps(V.cues(s, d)).select("video_id", "idx", "start_ms", "end_ms", "gap_class")
)
plan("w7_cps_headroom", "cues", f"""with c as (select *, end_ms - start_ms dur, greatest(0, coalesce({LEAD} - end_ms - 80, 2000)) free_right, greatest(0, coalesce(start_ms - {LAG} - 80, start_ms)) free_left from cues {V_}),
    n as (select *, greatest(0, least({EXPR['chars']} * 1000 // 15, greatest(dur, 21000)) - dur) need_ms from c)
    select video_id, idx, need_ms, free_left, free_right, case when need_ms = 0 then 'ok' when need_ms <= free_right then 'right' when need_ms <= free_right + free_left then 'both' else 'unfixable' end verdict from n""")(
    lambda s, d: C.cps_headroom(V.cues(s, d))
)
plan("w8_neighbour_slack", "cues", f"""with c as (select *, end_ms - start_ms dur, greatest(0, start_ms - {LAG} - 80) spare, start_ms - {LAG} g from cues {V_}),
    m as (select video_id, idx, greatest(0, 1200 - dur, {EXPR['chars']} * 1000 // 20 - dur) want_ms, (coalesce(sum(case when g is not null then spare end) over (v rows between 9 preceding and current row), 0)
    + case when row_number() over v <= 10 then first(start_ms) over v else 0 end)::bigint slack_left, coalesce(sum(case when g is not null then spare end) over (v rows between 1 following and 10 following), 0)::bigint slack_right from c {V_})
    select *, want_ms <= slack_left + slack_right fixable from m""")(lambda s, d: C.neighbour_slack(V.cues(s, d)))
plan("w9_donor_capacity", "cues", f"""with c as (select *, end_ms - start_ms dur, {EXPR['chars']} n from cues), g as (select *, greatest(0, dur - n * 100000 // 1500 - 80) a, greatest(0, dur - n * 100000 // 1900 - 80) b from c),
    h as (select *, case when a > 30 then a else 0 end a2, case when b > 30 then b else 0 end b2 from g)
    select video_id, idx, coalesce(sum(a2) over l, 0)::bigint target_left, coalesce(sum(a2) over r, 0)::bigint target_right, coalesce(sum(b2) over l, 0)::bigint hard_left, coalesce(sum(b2) over r, 0)::bigint hard_right from h
    window l as (partition by video_id order by idx rows between 8 preceding and 1 preceding), r as (partition by video_id order by idx rows between 1 following and 8 following)""")(lambda s, d: C.donor_capacity(V.cues(s, d)))
plan("w10_gap_budget", "cues", f"""with c as (select *, start_ms - {LAG} g from cues {V_}), u as (select *, case when g > 200 then g - 80 else 0 end u from c), b as (select *, coalesce(sum(u) over (v rows between 9 preceding and current row), 0)::bigint budget_left,
    coalesce(sum(u) over (v rows between 1 following and 10 following), 0)::bigint budget_right from u {V_}) select video_id, idx, budget_left, budget_right from b where {EXPR['chars']} * 1000 > 15 * (end_ms - start_ms)""")(lambda s, d: C.gap_budget(V.cues(s, d)))
plan("w11_pause_paragraphs", "cues", f"select video_id, idx, sum(coalesce((g > 400)::int, 0)) over v paragraph from (select *, start_ms - {LAG} g from cues {V_}) {V_}".replace("sum(coalesce", "(sum(coalesce").replace(") over v paragraph", ") over v)::bigint paragraph"))(
    lambda s, d: C.pause_paragraphs(V.cues(s, d), 400).select("video_id", "idx", "paragraph")
)
def merge_passes(passes: int = 5) -> str:
    """`passes` greedy passes, one after another, as SQL."""
    chain = ["mp0 as (select video_id, idx, start_ms, end_ms, text, 1::bigint parts from cues)"]
    for i in range(passes):
        chain.append(f"""mm{i} as (select *, end_ms - start_ms dur, {EXPR['chars']} n from mp{i}), mo{i} as (select *, lead(dur) over v dur2, lead(n) over v n2, lead(end_ms) over v e2, lead(start_ms) over v s2, lead(text) over v t2, lead(parts) over v p2 from mm{i} {V_}),
    mk{i} as (select *, coalesce((dur < 1200 or dur2 < 1200 or n * 1000 < 2 * dur or n2 * 1000 < 2 * dur2) and n + 1 + n2 <= 84 and e2 - start_ms <= 21000 and s2 - end_ms < 500, false) ok from mo{i}),
    mr{i} as (select *, idx - row_number() over (partition by video_id, ok order by idx) run from mk{i}), ms{i} as (select *, row_number() over (partition by video_id, ok, run order by idx) pos from mr{i}),
    mh{i} as (select *, ok and pos % 2 = 1 head from ms{i}), mt{i} as (select *, coalesce(lag(head) over v, false) tail from mh{i} {V_}),
    mp{i + 1} as materialized (select video_id, (row_number() over v)::int idx, start_ms, case when head then e2 else end_ms end end_ms, case when head then text || ' ' || t2 else text end as text, case when head then parts + p2 else parts end parts from mt{i} where not tail {V_})""")
    return "with " + ",\n".join(chain) + f" select * from mp{passes}"


plan("w23_merge_short_pairs", "cues", merge_passes())(lambda s, d: C.merge_short(V.cues(s, d)))
plan("w24_sparse_merge_forward", "cues", f"""with m as (select *, end_ms - start_ms + 4000 dur_ms, {EXPR['chars']} chars from cues), o as (select *, lead(chars) over v n2, lead(end_ms + 4000) over v e2, lead(start_ms) over v s2 from m {V_})
    select video_id, idx, chars, dur_ms, coalesce(s2 - (end_ms + 4000) <= 3000 and chars + 1 + n2 <= 84 and e2 - start_ms <= 21000, false) can from o where chars < 20 and dur_ms > 0 and chars * 1000 < 2 * dur_ms""")(
    lambda s, d: C.sparse_merge_forward(V.cues(s, d).withColumn("end_ms", F.col("end_ms") + 4000))
)
plan("w25_share_pauses", "cues", f"""with m as (select *, greatest(0, least(300, {EXPR['chars']} * 1000 // 15 - (end_ms - start_ms))) lack, greatest(0, start_ms - {LAG} - 80) free, {LAG} pe from cues {V_}),
    e as (select *, case when pe is null then 0 else least(lack, free) end early from m), l as (select *, case when lead(idx) over v is null then 0 else least(lack - early, lead(free - early) over v) end late from e {V_})
    select video_id, idx, start_ms - early start_ms, end_ms + late end_ms, early, late from l""")(lambda s, d: C.share_pauses(V.cues(s, d)))

STATS = f"""select video_id, count(*) blocks, sum({EXPR['chars']})::bigint chars, count(*) filter ({EXPR['chars']} * 1000 > 15 * (end_ms - start_ms)) over_target, count(*) filter ({EXPR['chars']} * 1000 > 20 * (end_ms - start_ms)) over_hard,
    count(*) filter ({EXPR['cpl']} > 84) over_cpl, count(*) filter (end_ms - start_ms < 1200) short, count(*) filter (end_ms - start_ms > 21000) long, count(*) filter (g < 0) "overlaps", count(*) filter (g >= 0 and g < 80) tight_gaps,
    sum({EXPR['cps100']})::bigint // count(*) avg_cps100, max({EXPR['cps100']})::bigint max_cps100, max({EXPR['cpl']})::int max_cpl, (sum({EXPR['cpl']}) * 100)::bigint // count(*) avg_cpl100,
    (list_sort(list({EXPR['cps100']}))[count(*) // 2 + 1])::bigint median_cps100 from (select *, start_ms - {LAG} g from {{t}} {V_}) group by video_id"""
plan("a1_video_stats", "cues", STATS.format(t="cues"))(lambda s, d: Q.video_stats(V.cues(s, d)))
plan("a7_overlap_report", "cues", f"""with g as (select video_id, idx, lag(idx) over v prev_idx, {LAG} - start_ms overlap_ms from cues {V_}), o as (select *, row_number() over (partition by video_id order by idx) n, count(*) over (partition by video_id) "overlaps" from g where overlap_ms > 0)
    select video_id, prev_idx, idx, overlap_ms, "overlaps" from o where n <= 10""")(lambda s, d: Q.overlap_report(V.cues(s, d)))
plan("a8_numbering_check", "edited_cues", "select video_id, count(*) filter (idx <> p) misnumbered from (select *, row_number() over (partition by video_id order by idx) p from edited_cues) group by 1")(lambda s, d: Q.numbering_check(V.edited_cues(V.cues(s, d))))
plan("a10_baseline_drift", "cues edited_cues", f"""with b as ({STATS.format(t='cues')}), n as ({STATS.format(t='edited_cues')})
    select video_id, list_filter([case when abs(n.blocks - b.blocks) > greatest(3, trunc(b.blocks * 0.02)) then 'blocks' end, case when abs(n.avg_cps100 - b.avg_cps100) > 100 then 'avg_cps' end,
    case when n.over_hard > greatest(2, trunc(1.5 * b.over_hard + 2)) then 'outliers' end, case when n.short > greatest(5, trunc(1.5 * b.short + 5)) then 'short' end], lambda x: x is not null) drift from n join b using (video_id)""")(
    lambda s, d: Q.baseline_drift(Q.video_stats(V.edited_cues(V.cues(s, d))), Q.video_stats(V.cues(s, d)))
)
plan("a12_corpus_info", "cues", "select video_id, count(*) cues, min(start_ms) first_ms, max(end_ms) last_ms, sum(len(string_split(text, ' ')))::bigint words from cues group by 1")(lambda s, d: Q.corpus_info(V.cues(s, d)))
plan("a13_glyph_coverage", "cues", "select video_id, array_to_string(list_sort(list_distinct(list_filter(string_split(string_agg(text, ''), ''), lambda c: c not in (' ', chr(10), chr(9))))), '') glyphs from cues group by 1")(lambda s, d: Q.glyph_coverage(V.cues(s, d)))
plan("k8_stats_report", "cues", f"with a as ({STATS.format(t='cues')}) select video_id, blocks, over_target * 1000 // blocks over_target_pm, over_hard * 1000 // blocks over_hard_pm, over_cpl * 1000 // blocks over_cpl_pm, short * 1000 // blocks short_pm from a")(lambda s, d: Q.stats_report(Q.video_stats(V.cues(s, d))))
plan("a2_before_after", "cues", f"""with w as (select video_id, idx, text, start_ms, (case when {LEAD} - end_ms < 80 then {LEAD} - 80 else end_ms end)::bigint end_ms from cues {V_}), b as ({STATS.format(t='cues')}), a as ({STATS.format(t='w')}),
    l as (select video_id, unnest([{{'m': 'blocks', 'b': b.blocks, 'a': a.blocks}}, {{'m': 'over_target', 'b': b.over_target, 'a': a.over_target}}, {{'m': 'over_hard', 'b': b.over_hard, 'a': a.over_hard}}, {{'m': 'over_cpl', 'b': b.over_cpl, 'a': a.over_cpl}},
    {{'m': 'short', 'b': b.short, 'a': a.short}}, {{'m': 'long', 'b': b.long, 'a': a.long}}, {{'m': 'overlaps', 'b': b."overlaps", 'a': a."overlaps"}}, {{'m': 'tight_gaps', 'b': b.tight_gaps, 'a': a.tight_gaps}}, {{'m': 'avg_cps100', 'b': b.avg_cps100, 'a': a.avg_cps100}},
    {{'m': 'max_cps100', 'b': b.max_cps100, 'a': a.max_cps100}}, {{'m': 'median_cps100', 'b': b.median_cps100, 'a': a.median_cps100}}, {{'m': 'max_cpl', 'b': b.max_cpl, 'a': a.max_cpl}}]) x from b join a using (video_id))
    select video_id, x.m metric, x.b "before", x.a "after", x.a - x.b change from l""")(lambda s, d: Q.before_after(V.cues(s, d), C.trim_overlaps(V.cues(s, d))))
plan("t1_worst_cps", "cues", f"""select video_id, idx, cps100, excerpt, rank from (select video_id, idx, ({EXPR['cps100']})::bigint cps100, case when length(text) > 60 then substr(text, 1, 60) || '...' else text end excerpt,
    (row_number() over (partition by video_id order by {EXPR['cps100']} desc, idx))::int rank from cues) where rank <= 10""")(lambda s, d: Q.worst_cps(V.cues(s, d)))
plan("k1_write_cues", "cues", """select video_id, string_agg(n || chr(10) || tc(start_ms) || ' --> ' || tc(end_ms) || chr(10) || text || chr(10) || chr(10), '' order by n) file from (select *, row_number() over (partition by video_id order by idx) n from cues) group by 1""".replace(
    "tc(start_ms)", "printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000)").replace("tc(end_ms)", "printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000)"))(
    lambda s, d: Q.cue_files(V.cues(s, d))
)
plan("k2_export_paragraph_text", "cues", f"""with p as (select *, sum(coalesce((g > 400)::int, 0)) over v para from (select *, start_ms - {LAG} g from cues {V_}) {V_}), q as (select video_id, para, string_agg(text, ' ' order by idx) t from p group by all)
    select video_id, 'Video ' || video_id || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by para) file from q group by 1""")(lambda s, d: Q.paragraph_files(C.pause_paragraphs(V.cues(s, d), 400)))
plan("k3_export_review_lines", "cues", "select video_id, string_agg('[' || idx || '] ' || replace(text, chr(10), ' '), chr(10) order by idx) file from cues group by 1")(lambda s, d: Q.review_files(V.cues(s, d)))
plan("f1_timecodes", "cues", "select video_id, idx, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) tc, start_ms back from cues")(
    lambda s, d: V.cues(s, d).select("video_id", "idx", T.ms_to_timecode(F.col("start_ms")).alias("tc")).withColumn("back", T.timecode_to_ms(F.col("tc")))
)
plan("f2_seconds_to_ms", "", "select event_id, trunc(value * 1000)::bigint truncated, round_even(value * 1000, 0)::bigint half_even from events")(
    lambda s, d: V.table(s, d, "events").select("event_id", T.seconds_to_ms(F.col("value")).alias("truncated"), T.seconds_to_ms(F.col("value"), True).alias("half_even"))
)
plan("f3_norm_word", "words", r"select video_id, cue_idx, w_pos, regexp_replace(lower(word), '[^\p{L}\p{N}_]+', '', 'g') norm from words")(lambda s, d: V.words(V.cues(s, d)).select("video_id", "cue_idx", "w_pos", T.norm_word(F.col("word")).alias("norm")))
plan("f4_norm_text", "", r"select doc_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) norm from documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", T.norm_text(F.col("text")).alias("norm")))
plan("f5_tokens", "", r"select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda t: regexp_matches(t, '[\p{L}\p{N}_]')) tokens from documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens")))
plan("f6_slugify", "", r"select item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 \-]+', '', 'g'), ' +', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') slug from benchmark")(
    lambda s, d: V.table(s, d, "benchmark").select("item_id", T.slugify(F.col("text")).alias("slug"))
)
plan("f8_split_sentences", "sentences", "select video_id, para_idx, (s_idx - 1)::int s_idx, text from (select video_id, para_idx, row_number() over (partition by video_id, para_idx order by s_idx) s_idx, text from sentences)")(
    lambda s, d: V.paragraphs(s, d).select("video_id", "para_idx", F.posexplode(T.sentences(F.col("text"))).alias("s_idx", "text"))
)
