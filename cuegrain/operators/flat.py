"""Kernels on videos' arrays: Arrow in and out, one entry a video, with flat NumPy arrays over many videos between.

A list of each video is worked on as one array with the video of each item beside it, so nothing is
done word by word but in C. Words are numbers, each normal form one. Workers get this module by value.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of Arrow that a kernel takes at once; what it makes of them is some ten times that.
SLICE = 8_000_000
MOST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: What is no letter, digit or underscore, as RE2 and DuckDB read it.
ODD = r"[^\p{L}\p{N}_]+"


def column(kernel, returns: str, *columns: Column, **fixed) -> Column:
    """The column that `kernel` makes of array columns: of Arrow arrays, some videos at a time, one of type `returns`."""
    def run(*arrays: pa.Array) -> pa.Array:
        made, n = [], len(arrays[0])
        step = max(1, n * SLICE // max(1, sum(a.nbytes for a in arrays)))
        for at in range(0, n, step):
            made.append(kernel(*[a.slice(at, step) for a in arrays], **fixed))
        return pa.concat_arrays(made) if made else kernel(*arrays, **fixed)

    return F.arrow_udf(run, returns)(*columns)


def items(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and the number of the list of each."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """`values`, which belong to the lists `owner`, as n lists."""
    offsets = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def struct(**fields) -> pa.Array:
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()], names=list(fields))


def ints(values: pa.Array, null: int = 0) -> np.ndarray:
    return pc.fill_null(values.cast(pa.int64()), null).to_numpy()


def div(a, b):
    """Whole division towards 0, as SQL has it."""
    q = np.abs(a) // np.abs(b)
    return np.where((a < 0) != (b < 0), -q, q)


def begins(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)


def ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each item in its run of equal keys, from 0."""
    at = begins(keys)
    return np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))


def after(values: np.ndarray, owner: np.ndarray, none: int) -> np.ndarray:
    """The value after each one of the same owner, `none` after the last."""
    out = np.full(len(values), none, dtype=values.dtype)
    same = owner[1:] == owner[:-1]
    out[:-1][same] = values[1:][same]
    return out


def before(values: np.ndarray, owner: np.ndarray, none: int) -> np.ndarray:
    return after(values[::-1], owner[::-1], none)[::-1]


def places(owner: np.ndarray, values: np.ndarray, of: np.ndarray, at: np.ndarray, side: str) -> np.ndarray:
    """Where each `at` of the owner `of` belongs among `values`, which are sorted by owner and value."""
    if not len(values) or not len(at):
        return np.zeros(len(at), dtype=np.int64)
    low, high = min(int(values.min()), int(at.min())), max(int(values.max()), int(at.max()))
    wide = high - low + 1
    if (max(int(owner[-1]), int(of.max())) + 1) * wide < 2**62:
        return np.searchsorted(owner * wide + (values - low), of * wide + (at - low), side)
    begin, end = np.searchsorted(owner, of), np.searchsorted(owner, of, "right")
    return np.array([a + np.searchsorted(values[a:z], x, side) for a, z, x in zip(begin, end, at, strict=True)], dtype=np.int64)


def coded(keys: np.ndarray | pa.Array) -> tuple[np.ndarray, int]:
    """Equal keys as equal numbers from 0, and how many there are."""
    found = (keys if isinstance(keys, pa.Array) else pa.array(keys)).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between single blanks, empty ones included, and the text of each; a null has none."""
    return items(pc.split_pattern(texts, " "))


def numbers(*words: pa.Array) -> list[np.ndarray]:
    """The words of each array as numbers, equal for equal normal forms (lower case, letters and digits only); -1 for none."""
    found = pa.concat_arrays([w.cast(pa.string()) for w in words]).dictionary_encode()
    forms = pc.replace_substring_regex(pc.utf8_lower(found.dictionary), ODD, "")
    of, _ = coded(forms)
    of[pc.equal(forms, "").to_numpy(zero_copy_only=False)] = -1
    return np.split(np.append(of, -1)[pc.fill_null(found.indices, len(of)).to_numpy()], np.cumsum([len(w) for w in words])[:-1])


def shared(x: np.ndarray, of_x: np.ndarray, y: np.ndarray, of_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and in y, both numbers of words with the video of each, of the triples that both sides of a video have once; in order of x."""
    n = int(max(x.max(initial=0), y.max(initial=0))) + 1
    words, side, of = np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)]), np.concatenate((of_x, of_y))
    if len(words) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero((of[2:] == of[:-2]) & (side[2:] == side[:-2]))
    first = of[at] * n + words[at]
    if (int(of.max()) + 1) * n**3 >= 2**63:
        first, n = coded(first * n + words[at + 1])[0], max(n, len(at))
        key, size = coded(first * n + words[at + 2])
    else:
        key, size = coded((first * n + words[at + 1]) * n + words[at + 2])
    mine = side[at] == 0
    once = (np.bincount(key[mine], minlength=size) == 1) & (np.bincount(key[~mine], minlength=size) == 1)
    place = np.zeros((2, size), dtype=np.int64)
    place[0, key[mine]], place[1, key[~mine]] = at[mine], at[~mine] - len(x)
    i, j = place[:, once]
    order = np.argsort(i)
    return i[order], j[order]


def chain(values: list, strict: bool = True) -> list[int]:
    """Places of a longest run of values that rises, or does not fall unless `strict`; of equally long ones, by patience sorting, the one that ends lowest."""
    from bisect import bisect_left, bisect_right

    place = bisect_left if strict else bisect_right
    tails, ends, links = [], [], []
    for k, v in enumerate(values):
        n = len(tails) if not tails or v > tails[-1] else place(tails, v)
        links.append(ends[n - 1] if n else -1)
        if n == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[n], ends[n] = v, k
    kept, at = [], ends[-1] if ends else -1
    while at >= 0:
        kept.append(at)
        at = links[at]
    return kept[::-1]


def rising(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which values are on the longest strictly rising run of their owner's; see chain."""
    keep = np.ones(len(values), dtype=bool)
    falls = np.unique(owner[1:][(owner[1:] == owner[:-1]) & (values[1:] <= values[:-1])])
    for a, z in zip(np.searchsorted(owner, falls), np.searchsorted(owner, falls, "right"), strict=True):
        keep[a:z] = False
        keep[a + np.array(chain(values[a:z].tolist()))] = True
    return keep


def spoken(cues: pa.Array) -> pa.Array:
    """The words heard of cues (idx, start_ms, end_ms, text); see views.words."""
    rows, video = items(cues)
    words, cue = split(rows.field("text"))
    idx, start, end = (ints(rows.field(c)) for c in ("idx", "start_ms", "end_ms"))
    p, n = ranks(cue), np.bincount(cue, minlength=len(rows))[cue]
    keep = (idx[cue] + p) % 13 != 0
    cue, p, n = cue[keep], p[keep], n[keep]
    long_ = (end - start)[cue]
    at = lambda k: start[cue] + div(k * long_, n)
    ends = at(p + 1) - (idx[cue] + p) % 4 * 10
    made = struct(cue_idx=rows.field("idx").take(pa.array(cue)), w_pos=p.astype(np.int32), word=words.filter(pa.array(keep)), start_ms=at(p), end_ms=ends)
    return lists(made, video[cue], len(cues))


def heard_spans(texts: pa.Array, video: np.ndarray, heard: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the words of each text as heard, MOST and LEAST for none, and whether one of its words is anchored.

    A video's anchors are the words of triples that its texts and its heard words each have once, the longest run of them
    that rises in both. Other words are at their share between the anchors around them, or at the edge of the outermost one.
    """
    said, of_said = items(heard)
    words, text = split(texts)
    x, y = numbers(words, said.field("word"))
    text, x = text[x >= 0], x[x >= 0]
    of_y = of_said[y >= 0]
    # nulls of times are taken for neither the first nor the last time
    first, last = ([ints(said.field(c), null)[y >= 0] for c in ("start_ms", "end_ms")] for null in (MOST, LEAST))
    y = y[y >= 0]
    of_x = video[text]
    i, j = shared(x, of_x, y, of_y)
    best = np.full(len(x) + 2, MOST)
    for k in range(3):
        best[i + k] = np.minimum(best[i + k], j + k)
    a = np.flatnonzero(best != MOST)
    kept = rising(best[a], of_x[a])
    a = a[kept]
    b = best[a]
    spans = np.full(len(texts), MOST), np.full(len(texts), LEAST), np.zeros(len(texts), dtype=bool)
    if not len(a):
        return spans
    lo = np.searchsorted(a, np.arange(len(x)), "right") - 1
    hi = np.minimum(lo + 1, len(a) - 1)
    has_hi = (lo + 1 < len(a)) & (of_x[a[hi]] == of_x)
    has_lo = (lo >= 0) & (of_x[a[lo]] == of_x)
    word = np.flatnonzero(has_lo | has_hi)
    lo, hi, has_lo, has_hi, text = lo[word], hi[word], has_lo[word], has_hi[word], text[word]
    exact = has_lo & (a[lo] == word)
    base = np.searchsorted(of_y, of_x[word])  # halves round to even numbers of the video's words
    gap = np.where(has_lo & has_hi, a[hi] - a[lo], 1)
    share = np.rint((b[lo] - base) + (b[hi] - b[lo]) * ((word - a[lo]) / gap))
    at = np.where(has_lo & has_hi & ~exact, base + np.where(has_lo & has_hi, share, 0).astype(np.int64), np.where(has_lo, b[lo], b[hi]))
    run = begins(text)
    begin = np.where(~has_hi & ~exact, first[1][at], first[0][at])
    end = np.where(~has_lo & ~exact, last[0][at], last[1][at])
    spans[0][text[run]], spans[1][text[run]], spans[2][text[run]] = np.minimum.reduceat(begin, run), np.maximum.reduceat(end, run), np.logical_or.reduceat(exact, run)
    return spans


def times(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=(values == MOST) | (values == LEAST))


def cue_times(cues: pa.Array, heard: pa.Array) -> pa.Array:
    """Of cues (idx, text) in order those with an anchored word, as (idx, start_ms, end_ms)."""
    rows, video = items(cues)
    start, end, exact = heard_spans(rows.field("text"), video, heard)
    return lists(struct(idx=rows.field("idx").filter(pa.array(exact)), start_ms=times(start[exact]), end_ms=times(end[exact])), video[exact], len(cues))


def edges(heard: pa.Array, pause: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The times at which words begin and end, each once in a video and in order: video, time, and loud unless a pause of at least `pause` ms begins or ends there."""
    said, video = items(heard)
    start, end = (ints(said.field(c), MOST) for c in ("start_ms", "end_ms"))
    next_ = after(start, video, MOST)
    quiet = (next_ != MOST) & (end != MOST)
    quiet[quiet] = next_[quiet] - end[quiet] >= pause
    of, t = np.concatenate((video, video)), np.concatenate((start, end))
    loud = np.ones(len(t), dtype=bool)
    loud[len(start) :][quiet] = False
    of, t, loud = np.concatenate((of, video[quiet])), np.concatenate((t, next_[quiet])), np.concatenate((loud, np.zeros(quiet.sum(), dtype=bool)))
    some = t != MOST
    of, t, loud = of[some], t[some], loud[some]
    low, wide = int(t.min(initial=MOST)), int(t.max(initial=LEAST)) - int(t.min(initial=MOST)) + 1
    if len(t) and (int(of.max()) + 1) * wide < 2**61:
        key = np.sort((of * wide + (t - low)) * 2 + loud)
        of, t, loud = key // 2 // wide, key // 2 % wide + low, key % 2 > 0
    else:
        order = np.lexsort((loud, t, of))
        of, t, loud = of[order], t[order], loud[order]
    keep = np.append(True, (of[1:] != of[:-1]) | (t[1:] != t[:-1]))[: len(t)]
    return of[keep], t[keep], loud[keep]


def boundaries(video, start, end, chars, moves, heard: pa.Array, least: int, pause: int, cps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cues in order those at whose end a boundary to the next one is proposed: their places, its time, and whether it is at a pause; see snap.pair_boundaries."""
    last = after(video, video, -1) < 0
    to, b = after(end, video, 0), after(chars, video, 0)
    long_ = end - start
    speed = np.where(long_ > 0, chars / np.where(long_ > 0, long_ / 1000, 1), 999.0)
    pair = np.flatnonzero(~last & (speed > cps) & moves & (after(moves.astype(np.int64), video, 0) > 0) & (to - start >= 2 * least) & (chars + b > 0))
    f, to, a, b, speed = start[pair], to[pair], chars[pair], b[pair], speed[pair]
    target = f + (to - f) * a / (a + b)
    of, t, loud = edges(heard, pause)

    def nearest(of, t):
        """For each pair the place of the time within it that is nearest its target, the earlier of equals; -1 for none."""
        lo, hi = places(of, t, video[pair], f + least, "left"), places(of, t, video[pair], to - least, "right")
        mid = np.clip(places(of, t, video[pair], np.floor(target).astype(np.int64), "right"), lo, np.maximum(lo, hi))
        left, right = np.maximum(mid - 1, 0), np.minimum(mid, max(len(t) - 1, 0))
        off = lambda k: np.abs(t[k] - target) if len(t) else target
        earlier = (mid > lo) & ((mid >= hi) | (off(left) <= off(right)))
        return np.where(lo < hi, np.where(earlier, left, right), -1)

    quiet = np.flatnonzero(~loud)
    still, any_ = nearest(of[quiet], t[quiet]), nearest(of, t)
    some = np.flatnonzero(any_ >= 0)
    calm = still[some] >= 0
    place = any_[some]
    place[calm] = quiet[still[some][calm]]
    at = t[place]
    pair, f, to, a, b, speed = pair[some], f[some], to[some], a[some], b[some], speed[some]
    slower = np.maximum(a / ((at - f) / 1000), b / ((to - at) / 1000)) < speed - 1
    return pair[slower], at[slower], calm[slower]


def timed(cues: pa.Array):
    rows, video = items(cues)
    return rows, video, *(ints(rows.field(c)) for c in ("start_ms", "end_ms", "chars"))


def pair_boundaries(cues: pa.Array, heard: pa.Array, least: int, pause: int, cps: int) -> pa.Array:
    """Of cues (idx, start_ms, end_ms, chars, moves) in order the boundaries (idx, boundary_ms, at_pause)."""
    rows, video, start, end, chars = timed(cues)
    moves = pc.fill_null(rows.field("moves"), False).to_numpy(zero_copy_only=False)
    pair, at, calm = boundaries(video, start, end, chars, moves, heard, least, pause, cps)
    return lists(struct(idx=rows.field("idx").take(pa.array(pair)), boundary_ms=at, at_pause=calm), video[pair], len(cues))


def snapped(cues: pa.Array, heard: pa.Array, least: int, gap: int, cps: int, least_part: int, pause: int) -> pa.Array:
    """Cues (idx, text, start_ms, end_ms, chars) in order as (idx, start_ms, end_ms, matched, boundary_ms); see snap.snap_to_speech."""
    rows, video, start, end, chars = timed(cues)
    begin, stop, exact = heard_spans(rows.field("text"), video, heard)
    matched = exact & (begin != MOST)
    start, end = np.where(matched, begin, start), np.where(exact & (stop != LEAST), stop, end)
    last = after(video, video, -1) < 0
    next_ = after(start, video, 0)
    end = np.where(~last & (next_ - end < gap), np.maximum(start, np.minimum(end, next_ - gap)), end)
    lack = np.where(matched, np.maximum(0, chars * 1000 // cps - (end - start)), 0)
    first = before(video, video, -1) < 0
    free = np.where(first, 0, np.maximum(0, start - before(end, video, 0) - gap))
    early = np.minimum(lack, free)
    late = np.where(last, 0, np.minimum(lack - early, after(free - early, video, 0)))
    start, end = start - early, end + late
    pair, at, _ = boundaries(video, start, end, chars, matched, heard, least_part, pause, cps)
    boundary = np.full(len(rows), MOST)
    boundary[pair] = at
    short = least - (end - start)
    room = np.where(last, short, after(start, video, 0) - gap - end)
    end = np.where(matched & (short > 0), end + np.maximum(0, np.minimum(short, room)), end)
    return lists(struct(idx=rows.field("idx"), start_ms=start, end_ms=end, matched=matched, boundary_ms=times(boundary)), video, len(cues))


def lineage(old: pa.Array, of_old: np.ndarray, new: pa.Array, of_new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of new and of old texts that share a triple of words which both sides of a video have once; each pair once, in order."""
    mine, of_mine = split(new)
    theirs, of_theirs = split(old)
    x, y = numbers(mine, theirs)
    of_mine, x, of_theirs, y = of_mine[x >= 0], x[x >= 0], of_theirs[y >= 0], y[y >= 0]
    i, j = shared(x, of_new[of_mine], y, of_old[of_theirs])
    pairs = np.unique(of_mine[i] * len(old) + of_theirs[j])
    return pairs // max(len(old), 1), pairs % max(len(old), 1)


def pauses(heard: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The silences of at least `least` ms between neighbouring words: video, begin and end, sorted."""
    said, video = items(heard)
    end, next_ = ints(said.field("end_ms"), MOST), after(ints(said.field("start_ms"), MOST), video, MOST)
    some = (end != MOST) & (next_ != MOST)
    some[some] = next_[some] - end[some] >= least
    video, end, next_ = video[some], end[some], next_[some]
    order = np.lexsort((next_, end, video))
    return video[order], end[order], next_[order]


def cut(of: np.ndarray, start: np.ndarray, end: np.ndarray, parts: np.ndarray, silent: tuple, margin: int):
    """Spans cut into `parts` at their longest inner pauses, evenly where there are too few: ends and begins of the parts around each cut, span by span, and whether by pauses."""
    video, a, z = silent
    lo = places(video, a, of, start + margin, "left")
    n = np.maximum(places(video, a, of, end - margin, "right") - lo, 0)
    span = np.repeat(np.arange(len(of)), n)
    pause = ranks(span) + lo[span]
    inner = (z[pause] <= end[span] - margin) & (z[pause] > start[span]) & (a[pause] < end[span])
    span, pause = span[inner], pause[inner]
    longest = np.lexsort((a[pause], a[pause] - z[pause], span))
    span, pause = span[longest], pause[longest]
    some = ranks(span) < parts[span] - 1
    span, pause = span[some], pause[some]
    by_pause = np.bincount(span, minlength=len(of)) == parts - 1
    order = np.lexsort((a[pause], span))
    pause = pause[order][by_pause[span[order]]]
    each = np.repeat(np.arange(len(of)), parts - 1)
    even = start[each] + div(end - start, parts)[each] * (ranks(each) + 1)
    ends, starts = even, even.copy()
    ends[by_pause[each]], starts[by_pause[each]] = a[pause], z[pause]
    return ends, starts, by_pause


def carried(old: pa.Array, new: pa.Array, heard: pa.Array, least: int, margin: int) -> dict:
    """Timing of cues (idx, text, from_ms, to_ms) carried over to blocks (id, text); see carry.carry_timing."""
    cues, of_old = items(old)
    blocks, of_new = items(new)
    n, o = lineage(cues.field("text"), of_old, blocks.field("text"), of_new)
    begin, end = ints(cues.field("from_ms"), MOST), ints(cues.field("to_ms"), MOST)
    has_time = (begin != MOST) & (end != MOST)
    block, cue = n[has_time[o]], o[has_time[o]]
    run = begins(block)
    timed_, first, last = block[run], *((f.reduceat(t[cue], run) if len(run) else t[:0]) for f, t in ((np.minimum, begin), (np.maximum, end)))
    # blocks of one source; those that share it split it
    single = np.bincount(n, minlength=len(blocks))[n] == 1
    mine, source = n[single], o[single]
    parts = np.bincount(source, minlength=len(cues))
    span = np.flatnonzero((parts > 1) & has_time)
    number = np.full(len(cues), -1)
    number[span] = np.arange(len(span))
    parts = parts[span]
    ends, starts, by_pause = cut(of_old[span], begin[span], end[span], parts, pauses(heard, least), margin)
    order = np.argsort(source, kind="stable")
    mine, source = mine[order], source[order]
    part, at = ranks(source), number[source]
    mine, part, at = mine[at >= 0], part[at >= 0], at[at >= 0]
    if len(span):
        here = np.cumsum(parts - 1)[at] - (parts - 1)[at] + part
        place = np.searchsorted(timed_, mine)
        first[place] = np.where(part == 0, begin[span][at], starts[np.maximum(here - 1, 0)])
        last[place] = np.where(part == parts[at] - 1, end[span][at], ends[np.minimum(here, len(ends) - 1)])
    return {"cues": cues, "of_old": of_old, "blocks": blocks, "of_new": of_new, "sources": np.unique(o), "timed": timed_, "start": first, "end": last, "of_span": of_old[span], "parts": parts, "by_pause": by_pause}


def carry_timing(old: pa.Array, new: pa.Array, heard: pa.Array, **limits) -> pa.Array:
    """The blocks with a timed source, numbered anew: (id, start_ms, end_ms, text)."""
    r = carried(old, new, heard, **limits)
    of = r["of_new"][r["timed"]]
    text = r["blocks"].field("text").take(pa.array(r["timed"]))
    return lists(struct(id=(ranks(of) + 1).astype(np.int32), start_ms=r["start"], end_ms=r["end"], text=text), of, len(new))


def carry_counts(old: pa.Array, new: pa.Array, heard: pa.Array, **limits) -> pa.Array:
    """For each video with cues one entry (before, after, dropped, splits, even)."""
    r = carried(old, new, heard, **limits)
    count = lambda of, weights=None: np.bincount(of, weights, minlength=len(old)).astype(np.int64)
    n = count(r["of_old"])
    made = struct(before=n, after=count(r["of_new"][r["timed"]]), dropped=n - count(r["of_old"][r["sources"]]), splits=count(r["of_span"], r["parts"] - 1), even=count(r["of_span"], ~r["by_pause"]))
    return lists(made.filter(pa.array(n > 0)), np.flatnonzero(n), len(old))


def halves(text: str, width: int, breaks: dict[str, int]) -> tuple[str, str]:
    """A text with a blank cut at one: where both halves are within width, after the best mark or before the best of `breaks`, else anywhere; of equal ones the nearest to the middle."""
    n = len(text)
    best, at = None, text.find(" ", max(0, n - 1 - width), width + 1)
    while at >= 0:
        end, stop = text[at - 1 : at], text.find(" ", at + 1)
        if end and end in ".!?":
            rank = 0
        elif end and end in ",;:—":
            rank = 1
        else:
            rank = breaks.get(text[at + 1 : stop if stop >= 0 else n].replace("İ", "i").lower().rstrip(".,;:!?"), 4)
        if best is None or (rank, abs(2 * at - n), at) < best:
            best = rank, abs(2 * at - n), at
        at = stop if stop <= width else -1
    if best is None:
        left, right = text.rfind(" ", 0, n // 2 + 1), text.find(" ", n // 2 + 1)
        at = left if right < 0 or (left >= 0 and abs(2 * left - n) <= abs(2 * right - n)) else right
    else:
        at = best[2]
    return text[:at], text[at + 1 :]


def split_to_width(texts: pa.Array, width: int, breaks: dict[str, int], once: bool = False) -> pa.Array:
    """Each text's parts within width in order, or its halves if `once`; single words stay whole, null stays."""
    def parts(text):
        out, rest = [], [text]
        while rest:
            t = rest.pop()
            if len(t) <= width or " " not in t:
                out.append(t)
            elif once:
                return list(halves(t, width, breaks))
            else:
                rest += reversed(halves(t, width, breaks))
        return out

    return pa.array([None if t is None else parts(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def aligned(segments: pa.Array, paragraphs: pa.Array) -> pa.Array:
    """Words of paragraphs (para_idx, text) timed by segments (seg_id, start_ms, end_ms, weight), both in order: (seg_id, p, word, start_ms, end_ms); see carry.align_translation."""
    rows, video = items(segments)
    texts, of_text = items(paragraphs)
    start, end, weight = (ints(rows.field(c)) for c in ("start_ms", "end_ms", "weight"))
    first = ranks(video) == 0
    gap = np.where(first, 0, start - before(end, video, 0))
    # the longest gaps cut, of equal ones the later
    order = np.lexsort((-np.arange(len(video)), -gap, first, video))
    rank = np.empty(len(video), dtype=np.int64)
    rank[order] = ranks(video[order])
    begin = first | (rank < np.bincount(of_text, minlength=len(segments))[video] - 1)
    group = np.cumsum(begin) - 1
    n_groups = int(begin.sum())
    # paragraphs by place, those too many to the last group
    groups = np.bincount(video[begin], minlength=len(segments))
    of_group = np.cumsum(groups)[of_text] - groups[of_text] + np.minimum(ranks(of_text), groups[of_text] - 1)
    words, text = split(pc.replace_substring(pc.replace_substring(texts.field("text"), "\t", " "), "\n", " "))
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    words, text = words.filter(pa.array(some)), text[some]
    has = groups[of_text[text]] > 0
    words, text = words.filter(pa.array(has)), text[has]
    count = np.bincount(of_group[text], minlength=n_groups)
    n, i = count[group], ranks(group)
    total = np.concatenate(([0], np.cumsum(weight)))
    at = begins(group)
    base, whole = total[:-1][at][group], np.diff(np.append(total[:-1][at], total[-1]))[group]
    target = np.rint(n * ((total[1:] - base) / np.maximum(whole, 1))).astype(np.int64)
    # at least one word each: i and the running maximum of target less i
    far = 2 * (int(n.max(initial=0)) + int(i.max(initial=0)) + 1)
    most = np.maximum.accumulate(target - i + group * far) - group * far if len(group) else group
    stop = np.where(after(group, video, -1) != group, n, i + np.maximum(1, most))
    from_ = before(stop, group, 0)
    size = np.maximum(np.minimum(stop, n) - from_, 0)
    seg = np.repeat(np.arange(len(rows)), size)
    p, k = ranks(seg), size[seg]
    place = (np.cumsum(count) - count)[group[seg]] + from_[seg] + p
    time = lambda q: div(start[seg] + div(q * (end - start)[seg], k) + 5, 10) * 10
    made = struct(seg_id=rows.field("seg_id").take(pa.array(seg)), p=p.astype(np.int32), word=words.take(pa.array(place)), start_ms=time(p), end_ms=time(p + 1))
    return lists(made, video[seg], len(segments))
