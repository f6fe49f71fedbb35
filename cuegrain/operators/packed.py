"""Videos as one row each, with their cues, words and pairs of words as arrays.

What is about neighbours, or about two versions of one video, is worked out in its row. So only the
texts of cues are shuffled, not words or runs of words; a row takes some tens of times its text, and
is gone when the next one comes. Python gets arrays of numbers, some hundred videos at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def in_rows(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row a video: its rows as an array of structs of `columns`, sorted by them."""
    return rows.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def rows_of(rows: DataFrame, found: Column) -> DataFrame:
    """The structs of an array column `found` of videos as rows, their fields beside video_id."""
    # the outer form, and the filter after it: else Spark puts one on the array before it, and so makes it twice
    return rows.select("video_id", F.explode_outer(found).alias("x")).where("x is not null").select("video_id", "x.*")


def normed_words(text: Column) -> Column:
    """The words between single blanks as norm_word makes them, empty ones included."""
    return F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_ ]+", ""), " ")


def stream(cues: Column, value) -> Column:
    """Normalised words (w, v) of an array of cues in order; `value` makes v of the cue, the word's place in it and its number of words."""
    def words(c: Column) -> Column:
        return let(normed_words(c["text"]), lambda ws: F.filter(F.transform(ws, lambda w, p: F.struct(w.alias("w"), value(c, p, F.size(ws)).cast("long").alias("v"))), lambda x: x["w"] != ""))

    return F.flatten(F.transform(cues, words))


def runs(items: Column, key) -> Column:
    """An array cut where `key` of neighbours differs, as an array of arrays."""
    def cut(s: Column) -> Column:
        begins = F.array_compact(F.transform(s["keys"], lambda k, i: F.when((i == 0) | ~k.eqNullSafe(F.get(s["keys"], i - 1)), i)))
        return let(begins, lambda at: F.transform(at, lambda b, n: F.slice(s["items"], b + 1, F.coalesce(F.get(at, n + 1), F.size(s["items"])) - b)))

    return let(F.struct(items.alias("items"), F.transform(items, key).alias("keys")), cut)


def times(items: Column) -> Column:
    """The arrays of starts and ends of an array of items, for the functions below."""
    return F.struct(F.transform(items, lambda x: x["start_ms"]).alias("starts"), F.transform(items, lambda x: x["end_ms"]).alias("ends"))


def touching(spans: Column, words: Column, closed: bool) -> Column:
    """For each of an array of spans the first start, last end and number of the words that overlap it, or touch it if `closed`; null and 0 without any."""
    def found(spans, words):
        import numpy as np

        if spans is None:
            return None
        known = [(a, z) for a, z in zip(words["starts"], words["ends"], strict=True) if a is not None and z is not None] if words is not None else []
        s, e = np.array(known, dtype=np.int64).reshape(-1, 2).T
        by_start, by_end = np.argsort(s, kind="stable"), np.argsort(e, kind="stable")
        starts, ends = s[by_start], e[by_end]
        last, first = np.maximum.accumulate(e[by_start]), np.minimum.accumulate(s[by_end][::-1])[::-1]
        back = s > e  # their ends are before their starts: counted one by one
        out = []
        for a, z in zip(spans["starts"], spans["ends"], strict=True):
            if a is None or z is None or not len(s):
                out.append((None, None, 0))
                continue
            begun = int(np.searchsorted(starts, z, "right" if closed else "left"))
            over = int(np.searchsorted(ends, a, "left" if closed else "right"))
            if begun == 0 or over == len(s) or (last[begun - 1] < a if closed else last[begun - 1] <= a):
                out.append((None, None, 0))
                continue
            n = begun - over
            if z <= a or back.any():
                n = int(np.count_nonzero((e >= a) & (s <= z) if closed else (e > a) & (s < z)))
            out.append((int(first[over]), int(last[begun - 1]), n) if n else (None, None, 0))
        return out

    return F.udf(found, "array<struct<first:bigint,last:bigint,n:bigint>>", useArrow=True)(spans, words)


def silences(spans: Column, words: Column) -> Column:
    """For each of an array of spans its longest stretch without one of the words that overlap it, lead-in and tail included; null without words."""
    def found(spans, words):
        import numpy as np

        if spans is None:
            return None
        known = [(a, z) for a, z in zip(words["starts"], words["ends"], strict=True) if a is not None and z is not None] if words is not None else []
        s, e = np.array(sorted(known), dtype=np.int64).reshape(-1, 2).T
        reached = np.maximum.accumulate(e)
        out = []
        for a, z in zip(spans["starts"], spans["ends"], strict=True):
            if a is None or z is None:
                out.append(None)
                continue
            near = slice(int(np.searchsorted(reached, a, "right")), int(np.searchsorted(s, z, "left")))
            inside = e[near] > a
            begin, end = np.maximum(s[near][inside], a), np.minimum(e[near][inside], z)
            if not len(begin):
                out.append(None)
                continue
            so_far = np.maximum.accumulate(end)
            holes = begin - np.concatenate(([a], so_far[:-1]))
            out.append(max(0, int(holes.max()), int(z - so_far[-1])))
        return out

    return F.udf(found, "array<bigint>", useArrow=True)(spans, words)


def word_time(c: Column, p: Column, n: Column) -> Column:
    return c["start_ms"] + div(p * (c["end_ms"] - c["start_ms"]), n)


def numbered(words: Column) -> Column:
    return F.transform(words, lambda x, i: F.struct(x["w"].alias("w"), i.cast("long").alias("v")))


def shared_triples(x: Column, y: Column) -> Column:
    """Of two arrays of words (w, v) the triples that each has once, as (a, b): v of their first words. Sorted together, such triples are neighbours without another of their kind."""
    def triples(words: Column, side: int) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: i + 2 < F.size(words))
        return F.transform(begins, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k)["w"] for k in range(3)]).alias("g"), F.lit(side).alias("side"), F.get(words, i)["v"].alias("v")))

    def once(both: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            same = lambda k: F.coalesce(F.get(both, i + k)["g"] == x["g"], F.lit(False))
            other = F.get(both, i + 1)
            return F.when((x["side"] == 0) & same(1) & (other["side"] == 1) & ~same(-1) & ~same(2), F.struct(x["v"].alias("a"), other["v"].alias("b")))

        return F.array_compact(F.transform(both, pair))

    return let(F.struct(x.alias("x"), y.alias("y")), lambda s: let(F.sort_array(F.concat(triples(s["x"], 0), triples(s["y"], 1))), once))


def first_of_each(pairs: Column, key: str = "a") -> Column:
    """The array of structs sorted, with the first of each value of `key`, its first field."""
    return let(F.sort_array(pairs), lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.coalesce(F.get(s, i - 1)[key] == x[key], F.lit(False))))


def rising(rows: DataFrame, pairs: str, strict: bool = True, points: Column | None = None) -> DataFrame:
    """`rows` with the array `pairs` (a, b), in order of a, cut to a longest run whose b rises, or does not fall unless `strict`; see longest_rising.

    With `points`, an array of numbers, also `places`: how many a of that run are below each.
    """
    def kept(values, keys, ts):
        from bisect import bisect_left, bisect_right

        place = bisect_left if strict else bisect_right
        tails, ends, links = [], [], []
        for k, v in enumerate(values):
            n = place(tails, v)
            tails[n : n + 1] = [v]
            ends[n : n + 1] = [k]
            links.append(ends[n - 1] if n else -1)
        chain, at = [], ends[-1] if ends else -1
        while at >= 0:
            chain.append(at)
            at = links[at]
        chain.reverse()
        left = [keys[k] for k in chain] if ts else []
        return chain, [None if t is None else bisect_left(left, t) for t in ts]

    ts = F.array().cast("array<bigint>") if points is None else points
    found = rows.withColumn("_r", F.udf(kept, "struct<kept:array<int>,places:array<int>>")(F.transform(pairs, lambda x: x["b"]), F.transform(pairs, lambda x: x["a"]), ts))
    # bound outside the inner function, in which Spark cannot call Python
    cut = found.withColumn(pairs, let(F.struct("_r", pairs), lambda r: F.transform(r["_r"]["kept"], lambda k: F.get(r[pairs], k))))
    return (cut if points is None else cut.withColumn("places", F.col("_r.places"))).drop("_r")


def places(points: Column, marks: Column) -> Column:
    """For each of an array of numbers how many of the sorted `marks` are below it; null for null."""
    def below(ts, ps):
        from bisect import bisect_left

        return [None if t is None else bisect_left(ps, t) for t in ts]

    return F.udf(below, "array<int>")(points, marks)
