"""Plans on splitting cues and timing them by heard words."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import edits as E
from ..operators import snap as N
from ..operators import splits as L
from ..staging import staged
from .align_plans import NORM, PAUSES, rising, stream
from .cue_plans import EXPR, V_
from .edit_plans import LIST
from .registry import plan


def near(mark: str) -> str:
    left = f"length(regexp_extract(substr(text, 1, m), '(?s)^(.*{mark}[ \t\n\r])', 1))"
    right = f"length(regexp_extract(substr(text, b), '(?s)^(.*?{mark}[ \t\n\r])', 1))"
    return f"(select case when l > 0 and (r = 0 or m - l <= b - 1 + r - m) then l when r > 0 then b - 1 + r end from (select {left} l, {right} r))"


BLOCK_SPLIT = f"coalesce({near('[.!?]')}, {near('[,;:—]')}, case when instr(substr(text, b), ' ') > 0 then b - 1 + instr(substr(text, b), ' ') end)"
RANKED = f"""case when regexp_matches(w[i], '[.!?]$') then 0 when regexp_matches(w[i], '[,;:]$') then 1 when regexp_replace(lower(w[i + 1]), '[.,;:!?]+$', '') in ({LIST(E.CONJUNCTIONS)}) then 2
    when regexp_replace(lower(w[i + 1]), '[.,;:!?]+$', '') in ({LIST(E.PREPOSITIONS)}) then 3 else 4 end"""
LINE_SPLIT = f"""case when length(text) > 84 then coalesce(case when length(text) <= 169 and contains(text, ' ') then list_min(list_transform(list_filter(range(1, len(w)), lambda i: e[i] <= 84 and length(text) - e[i] - 1 <= 84),
    lambda i: {{'score': {RANKED} * 1000 + abs(2 * e[i] - length(text) + 1), 'at': e[i]}}))['at'] end, case when instr(substr(text, m + 1), ' ') > 0 then m + instr(substr(text, m + 1), ' ') - 1 end) end"""
SPLIT = f"""sx as (select *, length(text) // 2 m, greatest(length(text) // 2, 1) b, case when length(text) <= 169 then string_split(text, ' ') else [''] end w from cues),
    sy as (select *, list_transform(range(1, len(w) + 1), lambda i: length(array_to_string(w[1:i], ' '))) e from sx)"""
plan("f19_find_split_point", "cues", f"with {SPLIT} select video_id, idx, ({BLOCK_SPLIT})::int block_at, ({LINE_SPLIT})::int line_at from sy")(
    lambda s, d: V.cues(s, d).select("video_id", "idx", L.block_split(F.col("text")).cast("int").alias("block_at"), L.line_split(F.col("text")).cast("int").alias("line_at"))
)
plan("w30_split_time_at_char", "cues words", f"""with {SPLIT}, sp as (select video_id, idx, {BLOCK_SPLIT} "at" from sy where length(text) > 84), p as (select *, coalesce(sum(length(word) + 1) over (partition by video_id, cue_idx order by w_pos rows between unbounded preceding and 1 preceding), 0) f from words)
    select sp.video_id, sp.idx, "at"::int "at", arg_min(case when f >= "at" then start_ms else end_ms end, w_pos) time_ms from sp join p on p.video_id = sp.video_id and p.cue_idx = sp.idx where f + length(word) >= "at" group by all""")(lambda s, d: split_times(s, d))


def split_times(s, d):
    cues = staged(V.cues(s, d), "cues")
    places = cues.where("length(text) > 84").select("video_id", "idx", L.block_split(F.col("text")).cast("int").alias("at"))
    return L.split_time(V.words(cues), places.where("at is not null"))


TIMED = f"""sp as (select video_id, idx, row_number() over (partition by video_id order by idx, p) - 1 j, w from {stream('edited_cues')}),
    hd as (select video_id, row_number() over (partition by video_id order by cue_idx, w_pos) - 1 i, w, start_ms, end_ms from (select *, {NORM.format('word').replace("{{", "{").replace("}}", "}")} w from words) where w <> ''),
    gj as materialized (select video_id, g, min(j) j from (select video_id, j, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o g from sp window o as (partition by video_id order by j)) where g is not null group by 1, 2 having count(*) = 1),
    gi as materialized (select video_id, g, min(i) i from (select video_id, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o g from hd window o as (partition by video_id order by i)) where g is not null group by 1, 2 having count(*) = 1),
    pr as (select video_id, jj j, min(ii) i from (select gj.video_id, j + k jj, i + k ii from gj join gi on gj.video_id = gi.video_id and gj.g = gi.g, (select unnest([0, 1, 2]) k)) group by 1, 2),
    an as materialized (select * from {rising('pr', 'j', 'i')}),
    mk as (select sp.*, an.j aj, an.i ai from sp left join an on sp.video_id = an.video_id and sp.j = an.j), bw as (select *, last_value(aj ignore nulls) over up lj, last_value(ai ignore nulls) over up li, last_value(aj ignore nulls) over dn hj, last_value(ai ignore nulls) over dn hi
    from mk window up as (partition by video_id order by j rows unbounded preceding), dn as (partition by video_id order by j desc rows unbounded preceding)),
    wi as (select *, case when li is null then hi when hi is null or lj = hj then li else round_even(li + (hi - li) * ((j - lj) / (hj - lj)), 0)::bigint end i from bw),
    wt as (select wi.video_id, idx, coalesce(lj = hj, false) exact, case when hi is null then end_ms else start_ms end s, case when li is null then start_ms else end_ms end e from wi join hd on hd.video_id = wi.video_id and hd.i = wi.i),
    ct as materialized (select video_id, idx, min(s) s, max(e) e from wt group by 1, 2 having bool_or(exact))"""
plan("j16_word_times_for_cues", "edited_cues words", f"with {TIMED} select video_id, idx, s start_ms, e end_ms from ct")(lambda s, d: timed(s, d, N.cue_times))


def timed(s, d, made):
    cues = V.cues(s, d)
    return made(V.edited_cues(cues), V.voiced(cues))


def boundary(rows: str, moves: str) -> str:
    """The pair boundaries of `rows`, as SQL."""
    return f"""mb as (select *, {EXPR['chars']} ca, case when end_ms > start_ms then {EXPR['chars']} / ((end_ms - start_ms) / 1000) else 999 end speed, {moves} mv from {rows}),
    pb as (select video_id, idx, start_ms f, lead(end_ms) over v t, ca a, lead(ca) over v b, speed, mv and lead(mv) over v both_ from mb {V_}),
    db as (select *, f + (t - f) * a / (a + b) target from pb where speed > 15 and both_ and t - f >= 1400),
    eg as materialized (select video_id, t, bool_or(z) z from (select video_id, start_ms t, false z from words union all select video_id, end_ms, false from words union all select video_id, unnest([ends, ends + pause_ms]), true from ({PAUSES}) where pause_ms >= 150) group by 1, 2),
    ob as (select db.video_id, idx, f, db.t, a, b, speed, min({{'loud': not z, 'off': abs(eg.t - target), 't': eg.t}}) o from db join eg on eg.video_id = db.video_id and eg.t >= f + 700 and eg.t <= db.t - 700 group by all),
    bd as (select video_id, idx, o.t boundary_ms, not o.loud at_pause from ob where greatest(a / ((o.t - f) / 1000), b / ((t - o.t) / 1000)) < speed - 1)"""


plan("j25_pair_boundary", "edited_cues words", f"with {boundary('edited_cues', 'true')} select * from bd")(lambda s, d: timed(s, d, N.pair_boundaries))
plan("c4_snap_to_speech", "edited_cues words", f"""with {TIMED}, s0 as (select c.video_id, c.idx, text, coalesce(s, start_ms) start_ms, coalesce(e, end_ms) end_ms, s is not null matched from edited_cues c left join ct using (video_id, idx)),
    s1 as (select * replace (case when lead(start_ms) over v - end_ms < 80 then greatest(start_ms, least(end_ms, lead(start_ms) over v - 80)) else end_ms end as end_ms) from s0 {V_}),
    s2 as (select *, case when matched then greatest(0, {EXPR['chars']} * 1000 // 15 - (end_ms - start_ms)) else 0 end lack, greatest(0, start_ms - lag(end_ms) over v - 80) free0, lag(end_ms) over v is null first_ from s1 {V_}),
    s3 as (select *, case when first_ then 0 else free0 end free, case when first_ then 0 else least(lack, free0) end early from s2), s4 as (select *, lead(free - early) over v rest from s3 {V_}),
    s5 as (select video_id, idx, text, matched, start_ms - early start_ms, end_ms + case when rest is null then 0 else least(lack - early, rest) end end_ms from s4), {boundary('s5', 'matched')},
    s6 as (select *, lead(start_ms) over v - 80 - end_ms room, 1000 - (end_ms - start_ms) short from s5 {V_})
    select s6.video_id, s6.idx, start_ms, case when matched and short > 0 then end_ms + greatest(0, least(short, coalesce(room, short))) else end_ms end end_ms, matched, boundary_ms from s6 left join bd using (video_id, idx)""")(
    lambda s, d: timed(s, d, N.snap_to_speech)
)
