"""Plans on joins of timed rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..operators import align as A
from ..operators import cues as C
from ..operators import quality as Q
from ..staging import staged
from .cue_plans import LAG, STATS
from .registry import plan

NORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def stream(t: str) -> str:
    words = f"string_split({NORM.format('text').replace('[^', '[^ ')}, ' ')"
    return f"""(select video_id, idx, p - 1 p, w, start_ms + ((p - 1) * (end_ms - start_ms)) // n t from (select video_id, idx, start_ms, end_ms, len(string_split(text, ' ')) n, unnest({words}) w, generate_subscripts({words}, 1) p from {t}) where w <> '')"""


def trigrams(t: str) -> str:
    return f"(select video_id, idx, t, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o g from {stream(t)} window o as (partition by video_id order by idx, p) qualify g is not null)"


def rising(rows: str, order: str, value: str, strict: bool = True) -> str:
    """Longest rising subsequence as SQL: chain lengths by a list of the lowest ends, then backwards the last row of each length."""
    less = f"len(list_filter(st.t, lambda q: q {'<' if strict else '<='} e.t[1]))"
    return f"""(select video_id, c[i].o "{order}", c[i].v "{value}" from (select video_id, c, unnest(list_reduce(list_prepend({{'w': list_max(l), 'k': []::bigint[], 'l': 0}},
        list_transform(list_reverse(range(1, len(l) + 1)), lambda i: {{'w': 0, 'k': [i], 'l': l[i]}})), lambda st, e: case when e.l = st.w then {{'w': st.w - 1, 'k': st.k || e.k, 'l': 0}} else st end).k) i
        from (select video_id, c, list_reduce(list_transform(c, lambda z: {{'t': [z.v], 'l': [1]::bigint[]}}), lambda st, e: {{'t': st.t[1:{less}] || e.t || st.t[{less} + 2:], 'l': st.l || [{less} + 1]}}).l l
        from (select video_id, list({{'o': "{order}", 'v': "{value}"}} order by "{order}") c from {rows} group by 1))))"""


ANCHORS = f"""with ga as materialized (select video_id, g, min(t) p, count(*) c from {trigrams('cues')} group by 1, 2), gb as materialized (select video_id, g, min(t) s, count(*) c from {trigrams('cues_b')} group by 1, 2),
    ab as materialized (select ga.video_id, p, min(s) s from ga join gb on ga.video_id = gb.video_id and ga.g = gb.g where ga.c = 1 and gb.c = 1 group by 1, 2)
    select video_id, p, s from {rising('ab', 'p', 's', strict=False)}"""

plan("j1_assemble_cues", "cues timecodes", "select c.video_id, c.idx, t.start_ms, t.end_ms, text from cues c join timecodes t on t.video_id = c.video_id and t.id = c.idx where t.start_ms < t.end_ms")(
    lambda s, d: A.assemble(V.cues(s, d).select("video_id", "idx", "text"), V.timecodes(V.cues(s, d)))[0].select("video_id", "idx", "start_ms", "end_ms", "text")
)
plan("j1_assemble_problems", "cues timecodes", """select video_id, idx, 'missing' problem from cues c where not exists (select 1 from timecodes t where t.video_id = c.video_id and t.id = c.idx)
    union all select video_id, id, 'no length' from timecodes where start_ms >= end_ms""")(lambda s, d: A.assemble(V.cues(s, d).select("video_id", "idx", "text"), V.timecodes(V.cues(s, d)))[1])
plan("j2_words_in_cue", "cues words", """select c.video_id, c.idx, coalesce(min(w.start_ms), any_value(c.start_ms)) speech_start, coalesce(max(w.end_ms), any_value(c.end_ms)) speech_end, count(w.word) n_words
    from cues c left join words w on w.video_id = c.video_id and w.end_ms >= c.start_ms and w.start_ms <= c.end_ms group by all""")(lambda s, d: A.speech_span(V.cues(s, d), V.spoken(V.cues(s, d))))
plan("j3_early_late_vs_speech", "cues segments", """with e as (select c.video_id, c.idx, c.start_ms t0, arg_min(g.start_ms, g.seg_id) sg from cues c join segments g on g.video_id = c.video_id and abs(g.start_ms - c.start_ms) <= 3000 group by all),
    l as (select c.video_id, c.idx, c.end_ms t0, arg_min(g.end_ms, g.seg_id) sg from cues c join segments g on g.video_id = c.video_id and abs(g.end_ms - c.end_ms) <= 3000 group by all)
    select video_id, cues, coalesce(early, 0) early, coalesce(late, 0) late from (select video_id, count(*) cues from cues group by 1) left join (select video_id, count(*) filter (t0 < sg - 500) early from e group by 1) using (video_id)
    left join (select video_id, count(*) filter (t0 > sg + 2000) late from l group by 1) using (video_id)""")(lambda s, d: A.early_late(V.cues(s, d), V.segments(V.cues(s, d))))
plan("j4_best_overlap_segment", "cues segments", """with p as (select c.*, seg_id, least(c.end_ms, g.end_ms) - greatest(c.start_ms, g.start_ms) o from cues c join segments g on g.video_id = c.video_id and c.start_ms < g.end_ms and c.end_ms > g.start_ms),
    b as (select *, row_number() over (partition by video_id, idx order by o desc, seg_id) r from p)
    select video_id, idx, seg_id, o overlap_ms, case when end_ms - start_ms > 7000 and length(text) * 100000 // (end_ms - start_ms) < 2600 and end_ms - start_ms - o >= 2000 then end_ms - start_ms - o else 0 end trim_ms from b where r = 1""")(
    lambda s, d: A.best_overlap(V.cues(s, d), V.segments(V.cues(s, d)))
)
plan("j6_anchor_map", "cues cues_b", ANCHORS)(lambda s, d: A.anchor_map(V.cues(s, d), V.second_recording(V.cues(s, d))))
plan("w18_monotone_anchors", "cues", """select video_id, p, s from (select *, max(s) over (partition by video_id order by p, s rows between unbounded preceding and 1 preceding) m from (select video_id, start_ms p, start_ms + (idx % 7) * 4000 s from cues)) where m is null or s >= m""")(
    lambda s, d: A.monotone(V.cues(s, d).select("video_id", F.col("start_ms").alias("p"), (F.col("start_ms") + (F.col("idx") % 7) * 4000).alias("s")))
)
REMAP = f"""with a as ({ANCHORS}), e as (select video_id, list(p order by p) ps, list(s order by p) ss, len(ps) n from a group by 1),
    q as (select video_id, idx, 'a' k, start_ms t from cues union all select video_id, idx, 'z', end_ms from cues),
    lo as (select q.*, a.p lp, a.s ls from q asof left join a on q.video_id = a.video_id and q.t > a.p), hi as (select lo.*, a.p hp, a.s hs from lo asof left join a on lo.video_id = a.video_id and lo.t <= a.p),
    m as (select hi.video_id, idx, k, t, case
      when t < ps[1] then case when ps[1] - t <= 2000 then greatest(0, case when n = 1 then ss[1] - (ps[1] - t) else trunc(ss[1] - (ss[2] - ss[1]) / (ps[2] - ps[1]) * (ps[1] - t))::bigint end) end
      when t > ps[n] then case when t - ps[n] <= 2000 then case when n = 1 then ss[n] + (t - ps[n]) else trunc(ss[n] + (ss[n] - ss[n - 1]) / (ps[n] - ps[n - 1]) * (t - ps[n]))::bigint end end
      when t = ps[1] then ss[1] else trunc(ls + (t - lp) / (hp - lp) * (hs - ls))::bigint end mapped from hi join e on e.video_id = hi.video_id)"""
plan("j5_remap_timeline", "cues cues_b", REMAP + """ select video_id, idx, start_ms, case when z <= start_ms then start_ms + 1 else z end end_ms from
    (select video_id, idx, max(mapped) filter (k = 'a') start_ms, max(mapped) filter (k = 'z') z from m group by all) where start_ms is not null and z is not null""")(
    lambda s, d: remapped(s, d).select("video_id", "idx", "start_ms", "end_ms")
)


def remapped(s, d):
    cues = V.cues(s, d)
    return A.remap_cues(A.anchored(cues, V.second_recording(cues)))


plan("c3_remap_recording", "cues cues_b", REMAP + f""", r as (select video_id, idx, text, a start_ms, case when z <= a then a + 1 else z end end_ms from
    (select video_id, idx, max(mapped) filter (k = 'a') a, max(mapped) filter (k = 'z') z from m group by all) join cues using (video_id, idx) where a is not null and z is not null),
    t as (select * replace (case when lead(start_ms) over v - end_ms < 80 then lead(start_ms) over v - 80 else end_ms end as end_ms) from r window v as (partition by video_id order by idx)),
    u as (select * replace (case when lead(start_ms) over v is null then greatest(end_ms, least(end_ms + 2000, start_ms + 21000)) else greatest(end_ms, least(lead(start_ms) over v - 80, end_ms + 5000, start_ms + 21000)) end as end_ms) from t window v as (partition by video_id order by idx))
    {STATS.format(t='u')}""")(lambda s, d: Q.video_stats(C.pad_into_silence(C.trim_overlaps(remapped(s, d)))))
WORDS = "select video_id, (row_number() over (partition by video_id order by {k}, i) - 1)::int pos, lower(x) w from (select video_id, {k}, unnest(string_split({t}, ' ')) x, generate_subscripts(string_split({t}, ' '), 1) i from {r}) where x <> ''"
plan("j7_text_preservation", "paragraphs edited_cues", f"""with a as ({WORDS.format(k='para_idx', t='text', r='paragraphs')}), b as ({WORDS.format(k='idx', t='text', r='edited_cues')}),
    j as (select video_id, pos, a.w x, b.w y from a full join b using (video_id, pos)), k as (select *, case when y is null then 'missing' when x is null then 'extra' else 'diff' end kind, x is distinct from y df from j)
    select video_id, count(x) source_words, count(y) made_words, min(pos) filter (df) first_diff, arg_min(kind, pos) filter (df) kind, min(pos) filter (df) is null equal from k group by 1""")(
    lambda s, d: A.text_preservation(V.paragraphs(s, d), V.edited_cues(V.cues(s, d)))
)
plan("j8_block_lineage", "cues edited_cues", f"""with o as (select video_id, g, min(idx) o from {trigrams('cues')} group by all having count(*) = 1), n as (select video_id, g, min(idx) n from {trigrams('edited_cues')} group by all having count(*) = 1)
    select video_id, n idx, list_sort(list_distinct(list(o))) old_ids from o join n using (video_id, g) group by all""")(lambda s, d: A.block_lineage(V.cues(s, d), V.edited_cues(V.cues(s, d))))
plan("j15_active_cue_at", "cues", """with p as (select video_id, unnest(range(0, e + 1, 777)) t from (select video_id, max(end_ms) e from cues group by 1)) select p.video_id, t, min(idx) idx from p join cues c on c.video_id = p.video_id and c.start_ms <= t and t < c.end_ms group by all""")(
    lambda s, d: played(s, d)
)


def played(s, d):
    """What stands on the screen every 777 ms of each video, from its start to its last cue's end."""
    cues = staged(V.cues(s, d), "cues")
    ends = cues.groupBy("video_id").agg(F.max("end_ms").alias("e"))
    return A.active_cue(cues, ends.select("video_id", F.explode(F.expr("sequence(0L, e, 777L)")).alias("t")))



plan("w16_speech_gap", "cues words", """with s as (select c.video_id, c.idx, any_value(c.start_ms) start_ms, any_value(c.end_ms) end_ms, min(w.start_ms) ws, max(w.end_ms) we from cues c left join words w on w.video_id = c.video_id and c.start_ms < w.end_ms and c.end_ms > w.start_ms group by 1, 2),
    g as (select video_id, idx, lead(start_ms) over v - end_ms gap, lead(ws) over v - we pause from s window v as (partition by video_id order by idx)) select video_id, idx, case when pause is null then gap else greatest(gap, pause) end gap_ms from g where gap is not null""")(
    lambda s, d: A.speech_gap(V.cues(s, d), V.spoken(V.cues(s, d)))
)
plan("w17_longest_silence", "segments words", """with i as (select g.video_id, g.seg_id idx, g.start_ms, g.end_ms, greatest(w.start_ms, g.start_ms) a, least(w.end_ms, g.end_ms) z from segments g join words w on w.video_id = g.video_id and g.start_ms < w.end_ms and g.end_ms > w.start_ms),
    h as (select *, a - coalesce(max(z) over (partition by video_id, idx order by a, z rows between unbounded preceding and 1 preceding), start_ms) hole from i),
    m as (select video_id, idx, greatest(0, max(hole), any_value(end_ms) - max(z)) silence_ms from h group by all) select g.video_id, seg_id idx, coalesce(silence_ms, 0) silence_ms from segments g left join m on m.video_id = g.video_id and m.idx = g.seg_id""")(
    lambda s, d: A.longest_silence(V.segments(V.cues(s, d)).withColumnRenamed("seg_id", "idx").select("video_id", "idx", "start_ms", "end_ms"), V.spoken(V.cues(s, d)))
)
PAUSES = "select video_id, cue_idx, w_pos, end_ms ends, lead(start_ms) over (partition by video_id order by cue_idx, w_pos) - end_ms pause_ms from words"
plan("a23_pause_stats", "words", f"select video_id, count(*) pauses, sum(pause_ms)::bigint total_ms, max(pause_ms) longest_ms from ({PAUSES}) where pause_ms >= 120 group by 1")(
    lambda s, d: A.pauses(V.words(V.cues(s, d))).groupBy("video_id").agg(F.count("*").alias("pauses"), F.sum("pause_ms").alias("total_ms"), F.max("pause_ms").alias("longest_ms"))
)
plan("t4_top_pauses", "words", f"select video_id, cue_idx, w_pos, ends, pause_ms, rank from (select *, (row_number() over (partition by video_id order by pause_ms desc, cue_idx, w_pos))::int rank from ({PAUSES}) where pause_ms >= 120) where rank <= 5")(
    lambda s, d: A.pauses(V.words(V.cues(s, d))).withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("pause_ms"), "cue_idx", "w_pos"))).where("rank <= 5")
)
plan("w12_largest_pause_groups", "segments", """with g as (select *, start_ms - lag(end_ms) over (partition by video_id order by seg_id) gap from segments), r as (select *, row_number() over (partition by video_id order by gap desc nulls last, seg_id desc) r from g)
    select video_id, seg_id, start_ms, end_ms, n_cues, sum((gap is not null and r <= 3)::int) over (partition by video_id order by seg_id)::bigint "group" from r""")(lambda s, d: A.pause_groups(V.segments(V.cues(s, d)), 4))
plan("w13_group_paragraph_map", "segments paragraphs", """with g as (select *, start_ms - lag(end_ms) over (partition by video_id order by seg_id) gap from segments), r as (select *, row_number() over (partition by video_id order by gap desc nulls last, seg_id desc) r from g),
    k as (select video_id, max(n) + 1 groups from (select video_id, sum((gap is not null and r <= 3)::int) over (partition by video_id order by seg_id) n from r) group by 1),
    p as (select *, row_number() over (partition by video_id order by para_idx) - 1 i from paragraphs) select video_id, least(i, groups - 1)::bigint "group", string_agg(text, ' ' order by para_idx) as text from p join k using (video_id) group by all""")(
    lambda s, d: group_texts(s, d)
)
plan("w14_proportional_text", "segments", r"""with t as (select doc_id video_id, list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda w: w <> '') w from documents), s as (select video_id, seg_id i, n_cues weight, w, len(w) n from segments join t using (video_id)),
    g as (select *, round_even(n * (sum(weight) over o::double / greatest(sum(weight) over a, 1)), 0)::int target, max(i) over a last from s window o as (partition by video_id order by i), a as (partition by video_id)),
    e as (select *, case when i = last then n else i + greatest(1, max(target - i) over (partition by video_id order by i)) end e from g), b as (select *, coalesce(lag(e) over (partition by video_id order by i), 0) b from e)
    select video_id, i, array_to_string(w[b + 1:e], ' ') as text from b""")(
    lambda s, d: A.proportional_text(V.segments(V.cues(s, d)).select("video_id", F.col("seg_id").alias("i"), F.col("n_cues").alias("weight")), V.table(s, d, "documents").select(F.col("doc_id").alias("video_id"), "text"))
)
plan("w15_uniform_word_times", "cues", """select video_id, idx, (p - 1)::int p, word, ((start_ms + ((p - 1) * (end_ms - start_ms)) // n + 5) // 10) * 10 start_ms, ((start_ms + (p * (end_ms - start_ms)) // n + 5) // 10) * 10 end_ms
    from (select *, len(string_split(text, ' ')) n, unnest(string_split(text, ' ')) word, generate_subscripts(string_split(text, ' '), 1) p from cues)""")(lambda s, d: A.uniform_word_times(V.cues(s, d)))
OFFSET = """n as (select video_id, n1, n2 from (select video_id, count(*) n1 from cues group by 1) full join (select video_id, count(*) n2 from cues_b group by 1) using (video_id)),
    j as (select video_id, idx, lower(c.text) = lower(b.text) same, b.start_ms - c.start_ms d from cues c join cues_b b using (video_id, idx)),
    g as (select video_id, count(*) filter (same) same, arg_min(d, idx) d0, max(d) filter (idx <= 10) hi, min(d) filter (idx <= 10) lo from j group by 1),
    r as (select *, case when n1 is null or n2 is null then 'absent' when n1 <> n2 then 'count' when same * 100 < n1 * 98 then 'text' when greatest(hi - d0, d0 - lo) > 500 then 'drift' end reason from n left join g using (video_id)),
    o as (select video_id, case when reason is null then d0 end offset_ms, reason from r)"""
plan("a4_detect_offset", "cues cues_b", f"with {OFFSET} select * from o")(lambda s, d: A.detect_offset(V.cues(s, d), V.second_recording(V.cues(s, d))))
plan("j24_secondary_plan", "cues cues_b manifests", f"""with {OFFSET}, k as (select m.video_id, p.video_id is null no_primary, offset_ms, reason from manifests m left join (select distinct video_id from cues where video_id % 5 <> 0) p using (video_id) left join o using (video_id) where role = 'secondary')
    select video_id, case when not no_primary and reason is distinct from 'absent' then case when offset_ms is not null then 'secondary-offset' else 'secondary-resync' end end mode, case when no_primary then 'no primary source' when reason = 'absent' then 'no own source' end skipped, offset_ms from k""")(
    lambda s, d: A.secondary_plan(V.manifests(s, d).where("role = 'secondary'").select("video_id"), V.cues(s, d).select("video_id").where("video_id % 5 <> 0").distinct(), A.detect_offset(V.cues(s, d), V.second_recording(V.cues(s, d))))
)
plan("c6_derive_secondary", "cues cues_b manifests", f"""with {OFFSET}, x as (select c.video_id, idx, text, greatest(0, start_ms + offset_ms) start_ms, end_ms + offset_ms end_ms from cues c join o using (video_id) where offset_ms is not null and end_ms + offset_ms > 0)
    select video_id, (row_number() over (partition by video_id order by idx))::int idx, text, start_ms, end_ms, 'secondary' as role, 'secondary-offset' as mode from x""")(
    lambda s, d: C.shift_timeline(V.cues(s, d), A.detect_offset(V.cues(s, d), V.second_recording(V.cues(s, d))).where("offset_ms is not null")).withColumns({"role": F.lit("secondary"), "mode": F.lit("secondary-offset")})
)


def group_texts(s, d):
    """Paragraph i goes to pause group i; surplus paragraphs to the last group."""
    groups = A.pause_groups(V.segments(V.cues(s, d)), 4).groupBy("video_id").agg((F.max("group") + 1).alias("groups"))
    paras = V.paragraphs(s, d).withColumn("i", F.row_number().over(Window.partitionBy("video_id").orderBy("para_idx")) - 1)
    placed = paras.join(groups, "video_id").withColumn("group", F.least(F.col("i"), F.col("groups") - 1))
    parts = F.array_sort(F.collect_list(F.struct("para_idx", "text")))
    return placed.groupBy("video_id", "group").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
