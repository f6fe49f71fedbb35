"""Plans on keeping cues and transcripts in step, and on carrying timing over."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import carry as R
from ..operators import edits as E
from ..operators import sync as Y
from ..staging import staged
from .align_plans import rising, trigrams
from .edit_plans import BLOCKS, CHANGED, FRAGMENT, GRAMS, PAUSE, changed, edited_paragraphs
from .registry import plan
from .state_plans import VERDICT, checked

SOLID = "[^ \t\n\r\f\v]+"
CNT = lambda x: f"len(regexp_extract_all({x}, '{SOLID}'))"
FOLD = lambda x: f"trim(regexp_replace({x}, '[ \t\n\r\f\v]+', ' ', 'g'))"
OFF = lambda t, k: f"(length(array_to_string(string_split({t}, ' ')[1:({k})], ' ')) + least({k}, 1))"
BEFORE = "rows between unbounded preceding and 1 preceding"
LOCATE = f"""fr as materialized ({FRAGMENT}), pc as (select *, {CNT('text')} n, coalesce(sum({CNT('text')}) over (partition by video_id order by para_idx {BEFORE}), 0)::bigint w0 from paragraphs),
    sm as (select video_id from (select video_id, {FOLD("string_agg(text, ' ' order by para_idx)")} x from paragraphs group by 1) join (select video_id, {FOLD("string_agg(text, ' ' order by idx)")} y from cues group by 1) using (video_id) where x = y),
    l0 as (select fr.*, text, n, w0, "at" lo, "at" + length(old_part) hi from fr join pc using (video_id, para_idx)),
    l1 as (select *, {CNT('substr(text, 1, lo)')} - case when lo > 0 and regexp_matches(substr(text, lo, 1), '{SOLID}') and regexp_matches(substr(text, lo + 1, 1), '{SOLID}') then 1 else 0 end k0, {CNT('substr(text, 1, hi)')} - 1 k1 from l0),
    l2 as (select *, case when k1 < k0 then case when k0 < n then k0 else n - 1 end else k0 end t0 from l1), cc as (select video_id, idx, text cue, {CNT('text')} c, coalesce(sum({CNT('text')}) over (partition by video_id order by idx {BEFORE}), 0)::bigint c0 from cues),
    ht as (select l2.video_id, para_idx, idx, ({OFF('cue', 'w0 + t0 - c0')} + "at" - {OFF('text', 't0')})::int "offset" from l2 join sm using (video_id) join cc on cc.video_id = l2.video_id and c0 <= w0 + t0 and w0 + greatest(t0, k1) <= c0 + c - 1 and c > 0),
    lc as (select fr.*, idx, "offset" from fr left join ht using (video_id, para_idx))"""
plan("j19_locate_fragment", "paragraphs cues", f"with {LOCATE} select * from lc")(lambda s, d: Y.locate_fragments(*changes(s, d)))


def edits_of(s, d):
    """The fragments of edited paragraphs; one row with para_idx null for a video whose paragraphs differ in number."""
    diffs = E.paragraph_diff(V.paragraphs(s, d), edited_paragraphs(s, d))
    return staged(diffs.select("video_id", "para_idx", E.minimal_fragment(F.col("old"), F.col("new")).alias("f")).select("video_id", "para_idx", "f.*"), "fragments")


def changes(s, d, cues=None, edits=None):
    cues = staged(V.cues(s, d), "cues") if cues is None else cues
    edits = edits_of(s, d) if edits is None else edits
    return V.paragraphs(s, d), edits.where("para_idx is not null"), cues


FIRST = lambda t: f"substr({t}, 1, instr({t}, old_part) - 1) || new_part || substr({t}, instr({t}, old_part) + length(old_part))"
APPLY = f"""{LOCATE}, jc as (select lc.*, cue from lc left join (select video_id, idx, text cue from cues) using (video_id, idx)),
    rs as (select *, case when old_part = '' then 'nothing to find' when "offset" >= 0 and substr(cue, "offset" + 1, length(old_part)) = old_part then 'located' when instr(cue, old_part) > 0 then 'right cue' end r0 from jc),
    hc as (select rs.video_id, rs.para_idx, count(*) hits, min({{'idx': c.idx, 'cue': c.text}}) hit from rs join cues c on c.video_id = rs.video_id and instr(c.text, rs.old_part) > 0 where r0 is null group by 1, 2),
    ap as (select video_id, para_idx, coalesce(r0, case when hits is null then 'not found' when hits > 1 then 'ambiguous' else 'only one' end) result, case when r0 is not null then idx when hits = 1 then hit.idx end idx,
    case when r0 = 'located' then substr(cue, 1, "offset") || new_part || substr(cue, "offset" + 1 + length(old_part)) when r0 = 'right cue' then {FIRST('cue')} when r0 is null and hits = 1 then {FIRST('hit.cue')} end as text from rs left join hc using (video_id, para_idx))"""
plan("j20_apply_text_edit", "paragraphs cues", f"with {APPLY} select *, coalesce(length(text) > 84, false) over_width from ap")(lambda s, d: Y.apply_edits(Y.placed(*changes(s, d))))
# the best chain that ends at each cell, after the lowest of the best cells before it in both orders
PRED = "list_max(list_transform(list_filter(range(1, e.k), lambda j: c[j].a < c[e.k].a and c[j].b < c[e.k].b), lambda j: {'v': st.best[j], 'n': -j}))"
CHAIN = f"""list_reduce(list_transform(range(1, len(c) + 1), lambda k: {{'best': [c[k].s], 'path': [[k]], 'k': k}}), lambda st, e:
    {{'best': st.best || [c[e.k].s + coalesce({PRED}.v, 0)], 'path': st.path || [coalesce(st.path[-({PRED}.n)], []) || [e.k]], 'k': e.k}})"""
PROPAGATE = f"""oa as (select video_id, idx, text, row_number() over (partition by video_id order by idx) a, row_number() over (partition by video_id, text order by idx) use from cues), nb as (select video_id, idx, text, row_number() over (partition by video_id order by idx) b, row_number() over (partition by video_id, text order by idx) use from edited_cues),
    kp as (select video_id, a, b, 1 k from {rising('(select oa.video_id, a, b from oa join nb using (video_id, text, use))', 'a', 'b')}),
    ro as (select oa.video_id, a, text, k is not null kept, coalesce(sum(k) over (partition by video_id order by a), 0) rg from oa left join kp using (video_id, a)), rn as (select nb.video_id, b, text, k is not null kept, coalesce(sum(k) over (partition by video_id order by b), 0) rg from nb left join kp using (video_id, b)),
    so as (select video_id, rg, count(*) no, {FOLD("string_agg(text, ' ' order by a)")} x from ro where not kept group by 1, 2), sn as (select video_id, rg, count(*) nn, {FOLD("string_agg(text, ' ' order by b)")} y from rn where not kept group by 1, 2),
    sz as (select video_id, rg, coalesce(no, 0) no, coalesce(nn, 0) nn, case when coalesce(x, '') = coalesce(y, '') then 'reblocked' when coalesce(no, 0) = coalesce(nn, 0) then 'paired' when nn is null then 'deleted' when no is null then 'inserted' else 'mixed' end kind from so full join sn using (video_id, rg)),
    mo as (select {{'v': video_id, 'r': rg}} video_id, a idx, text from ro join sz using (video_id, rg) where not kept and kind = 'mixed'), mn as (select {{'v': video_id, 'r': rg}} video_id, b idx, text from rn join sz using (video_id, rg) where not kept and kind = 'mixed'),
    ga as (select video_id, idx old, len(g) n_old, unnest(g) g from {GRAMS.replace('@@', 'mo')}), gb as (select video_id, idx "new", len(g) n_new, unnest(g) g from {GRAMS.replace('@@', 'mn')}),
    sc as (select ga.video_id, old, "new", count(*) * 100 // (any_value(n_old) + any_value(n_new) - count(*)) score from ga join gb on ga.video_id = gb.video_id and ga.g = gb.g group by 1, 2, 3 having score > 50),
    cl as (select video_id, list({{'a': old, 'b': "new", 's': score}} order by old, "new") c from sc group by 1), ck as (select video_id, c, {CHAIN} r from cl),
    al as (select distinct video_id.v video_id, video_id.r rg, c[k].a a from (select video_id, c, unnest(r.path[list_position(r.best, list_max(r.best))]) k from ck)),
    tr as (select video_id, {FOLD("string_agg(text, ' ' order by para_idx)")} t from paragraphs group by 1),
    ol as (select ro.video_id, kind, al.a is not null pd, coalesce(contains(' ' || t || ' ', ' ' || {FOLD('ro.text')} || ' '), false) there from ro join sz using (video_id, rg) left join al on al.video_id = ro.video_id and al.rg = ro.rg and al.a = ro.a left join tr on tr.video_id = ro.video_id where not kept),
    ch as (select video_id, count(*) filter (kind = 'paired' or pd) changed, count(*) filter ((kind = 'deleted' or (kind = 'mixed' and not pd)) and there) removed, count(*) filter ((kind = 'deleted' or (kind = 'mixed' and not pd)) and not there) skipped from ol group by 1),
    ex as (select video_id, count(*) filter (kind = 'reblocked') reblocked, sum(case kind when 'inserted' then nn when 'mixed' then nn - coalesce(m, 0) else 0 end)::bigint inserted from sz left join (select video_id, rg, count(*) m from al group by 1, 2) using (video_id, rg) group by 1),
    dr as (select ro.video_id, count(*) filter (not coalesce(contains(' ' || lower(t) || ' ', ' ' || lower({FOLD('text')}) || ' '), false)) drifted from ro left join tr using (video_id) where kept group by 1),
    pg as (select video_id, coalesce(changed, 0) changed, coalesce(removed, 0) removed, coalesce(skipped, 0) skipped, coalesce(drifted, 0) drifted, coalesce(reblocked, 0) reblocked, coalesce(inserted, 0) inserted from (select distinct video_id from cues) left join ch using (video_id) left join ex using (video_id) left join dr using (video_id))"""
plan("j21_propagate_block_edits", "paragraphs cues edited_cues", f"with {PROPAGATE} select * from pg")(lambda s, d: propagated(s, d))


def propagated(s, d, cues=None):
    cues = staged(V.cues(s, d), "cues") if cues is None else cues
    return Y.propagate(cues, V.edited_cues(cues), V.paragraphs(s, d))


plan("c8_sync_review", "paragraphs cues edited_cues cues_b manifests", f"""with cg as ({CHANGED}), ed as (select video_id, count(*) filter (good) applied, count(*) filter (not good) refused from (select video_id, result in ('located', 'right cue', 'only one') and coalesce(length(text) <= 84, true) good from (with {APPLY} select * from ap)) group by 1),
    vd as ({VERDICT} select video_id, "text" and overlap and "time" and numbering and cpl and gap and block_ratio and duration and cps passed from v), pp as (with {PROPAGATE} select * from pg)
    select cg.video_id, cues_edited, transcript_edited, coalesce(applied, 0) applied, coalesce(refused, 0) refused, coalesce(changed, 0) changed, coalesce(removed, 0) removed, coalesce(inserted, 0) inserted,
    case when coalesce(refused, 0) + coalesce(inserted, 0) > 0 then 'rebuild' when coalesce(passed, false) then 'ready' else 'review' end state from cg left join ed using (video_id) left join pp using (video_id) left join vd using (video_id)""")(
    lambda s, d: reviewed(s, d)
)


def reviewed(s, d):
    cues = staged(V.cues(s, d), "cues")
    edits = edits_of(s, d)
    return Y.review(changed(s, d, cues, edits), Y.apply_edits(Y.placed(*changes(s, d, cues, edits))), propagated(s, d, cues), checked(s, d, cues))



CARRY = f"""{BLOCKS}, bt as (select video_id, id idx, text, 0 start_ms, 0 end_ms from bl), ot as materialized (select video_id, g, min(idx) o from {trigrams('cues')} group by 1, 2 having count(*) = 1), nt as materialized (select video_id, g, min(idx) n from {trigrams('bt')} group by 1, 2 having count(*) = 1),
    src as (select ot.video_id, n id, list_distinct(list(o)) ids from ot join nt on ot.video_id = nt.video_id and ot.g = nt.g group by 1, 2), sg as (select video_id, id, ids[1] idx from src where len(ids) = 1), sh as (select video_id, idx, count(*) parts from sg group by 1, 2 having count(*) > 1),
    ss as (select sh.video_id, sh.idx, parts, t.start_ms s, t.end_ms e from sh join timecodes t on t.video_id = sh.video_id and t.id = sh.idx), {PAUSE},
    pi as (select ss.video_id, ss.idx, parts, r_start, r_end, row_number() over (partition by ss.video_id, ss.idx order by r_end - r_start desc, r_start) r from ss join pz on pz.video_id = ss.video_id and s + 200 <= r_start and r_end <= e - 200 and r_end > s and r_start < e),
    pc as (select video_id, idx, list({{'a': r_start, 'z': r_end}} order by r_start) c from pi where r < parts group by 1, 2), pk as (select ss.*, coalesce(len(c) = parts - 1, false) bp, c from ss left join pc using (video_id, idx)),
    pq as (select *, case when bp then c else list_transform(range(1, parts), lambda i: {{'a': s + (e - s) // parts * i, 'z': s + (e - s) // parts * i}}) end cc from pk), pp as (select *, unnest(range(0, parts)) part from pq),
    pt as (select video_id, idx, part, case when part = 0 then s else cc[part].z end a_, case when part = parts - 1 then e else cc[part + 1].a end z_, bp from pp),
    mine as (select m.video_id, m.id, a_, z_ from (select sg.*, row_number() over (partition by sg.video_id, sg.idx order by id) - 1 part from sg join sh using (video_id, idx)) m join pt on pt.video_id = m.video_id and pt.idx = m.idx and pt.part = m.part),
    so as (select video_id, id, unnest(ids) o from src), tm as (select so.video_id, so.id, min(t.start_ms) s, max(t.end_ms) e from so join timecodes t on t.video_id = so.video_id and t.id = so.o group by 1, 2)"""
plan("c7_carry_timing", "sentences cues timecodes words", "with " + CARRY + " select video_id, (row_number() over (partition by video_id order by id))::int id, coalesce(a_, s) start_ms, coalesce(z_, e) end_ms, text from tm left join mine using (video_id, id) join bl using (video_id, id)")(lambda s, d: R.carry_timing(*carried(s, d)))
plan("c7_carry_counts", "sentences cues timecodes words", "with " + CARRY + """ select video_id, "before", coalesce("after", 0) "after", coalesce(dropped, 0) dropped, coalesce(splits, 0) splits, coalesce(even, 0) even from (select video_id, count(*) "before" from cues group by 1) left join (select video_id, count(*) "after" from tm group by 1) using (video_id)
    left join (select video_id, count(*) dropped from (select video_id, idx from cues except select video_id, o from so) group by 1) using (video_id) left join (select video_id, count(*) filter (part > 0) splits, count(*) filter (part = 0 and not bp) even from pt group by 1) using (video_id)""")(lambda s, d: R.carry_counts(*carried(s, d)))


def carried(s, d):
    return V.timecoded(V.cues(s, d)), E.blocks(V.paragraphs(s, d)).select("video_id", "id", "text")


plan("c5_align_translation", "segments paragraphs", r"""with np as (select video_id, count(*) groups from paragraphs group by 1), g as (select s.*, groups, start_ms - lag(end_ms) over (partition by s.video_id order by seg_id) gap from segments s join np on np.video_id = s.video_id),
    r as (select *, row_number() over (partition by video_id order by gap desc nulls last, seg_id desc) r from g), gr as (select *, sum((gap is not null and r <= groups - 1)::int) over (partition by video_id order by seg_id) grp from r), k as (select *, row_number() over (partition by video_id, grp order by seg_id) - 1 i from gr),
    lg as (select video_id, max(grp) last from gr group by 1), pl as (select p.video_id, least(row_number() over (partition by p.video_id order by para_idx) - 1, last) grp, para_idx, text from paragraphs p join lg on lg.video_id = p.video_id),
    tx as (select video_id, grp, list_filter(regexp_split_to_array(string_agg(text, ' ' order by para_idx), '[ \t\n]+'), lambda w: w <> '') w from pl group by 1, 2), s as (select k.*, w, len(w) n from k join tx on tx.video_id = k.video_id and tx.grp = k.grp),
    tg as (select *, round_even(n * (sum(n_cues) over o::double / greatest(sum(n_cues) over a, 1)), 0)::int target, max(i) over a last_i from s window o as (partition by video_id, grp order by i), a as (partition by video_id, grp)),
    e as (select *, case when i = last_i then n else i + greatest(1, max(target - i) over (partition by video_id, grp order by i)) end e from tg), b as (select *, coalesce(lag(e) over (partition by video_id, grp order by i), 0) b from e), t as (select video_id, seg_id, start_ms, end_ms, w[b + 1:e] ws from b where len(w[b + 1:e]) > 0)
    select video_id, seg_id, (p - 1)::int p, word, ((start_ms + ((p - 1) * (end_ms - start_ms)) // n + 5) // 10) * 10 start_ms, ((start_ms + (p * (end_ms - start_ms)) // n + 5) // 10) * 10 end_ms from (select *, len(ws) n, unnest(ws) word, generate_subscripts(ws, 1) p from t)""")(
    lambda s, d: R.align_translation(V.segments(V.cues(s, d)).withColumnRenamed("n_cues", "weight"), V.paragraphs(s, d))
)
