"""Rising runs, ordered pairings, q-gram and phrase look-ups against brute force and planted cases."""

import itertools
import random

from pyspark.sql import functions as F

from cuegrain.operators import align as A
from cuegrain.operators import sequences as Q
from cuegrain.operators import snap as N
from cuegrain.operators import sync as Y


def test_longest_rising_by_force(spark):
    rng = random.Random(5)
    rows = [(v, p, rng.randrange(9)) for v in range(60) for p in range(rng.randrange(1, 11))]
    df = spark.createDataFrame(rows, "video_id long, p long, s long").repartition(5)
    for strict in (True, False):
        got = {}
        for r in Q.longest_rising(df, "p", "s", strict).collect():
            got.setdefault(r.video_id, []).append((r.p, r.s))
        for v, own in itertools.groupby(rows, lambda r: r[0]):
            own = [r[1:] for r in own]
            rises = lambda c: all(a[1] < b[1] or (not strict and a[1] == b[1]) for a, b in zip(c, c[1:]))  # noqa: B023, E731
            most = max(n for n in range(1, len(own) + 1) for c in itertools.combinations(own, n) if rises(c))
            kept = sorted(got[v])
            assert len(kept) == most and rises(kept) and set(kept) <= set(own)


def test_longest_rising_empty_and_null(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5), (None, 3, 4)], "video_id long, p long, s long")
    assert sorted(map(tuple, Q.longest_rising(df, "p", "s").collect()), key=repr) == [(1, 2, 5), (None, 3, 4)]
    assert Q.longest_rising(df.where("p > 9"), "p", "s").count() == 0


def lines(n, skip=()):
    return [(7, i, f"alpha{i} beta{i} gamma{i} delta{i}", i * 1000, i * 1000 + 900) for i in range(n) if i not in skip]


CUES = "video_id long, idx int, text string, start_ms long, end_ms long"


def test_one_false_far_anchor_keeps_all_others(spark):
    """A phrase that each recording says once, early in one and late in the other, drops out alone."""
    odd = "odd one out"
    first = spark.createDataFrame([*lines(30), (7, 30, odd, 2500, 2600)], CUES)
    second = spark.createDataFrame([*lines(30), (7, 30, odd, 90_000, 90_900)], CUES)
    # the odd phrase stands third in order of the first recording's time, and far ahead in the second's
    placed = first.withColumn("idx", F.when(F.col("text") == odd, F.lit(3)).otherwise(F.when(F.col("idx") >= 3, F.col("idx") + 1).otherwise(F.col("idx"))))
    got = A.anchor_map(placed, second)
    times = {(r.p, r.s) for r in got.collect()}
    assert all((i * 1000, i * 1000) in times for i in range(30)) and not any(s >= 90_000 for _, s in times)


def test_one_false_heard_anchor_keeps_all_others(spark):
    written = spark.createDataFrame([(7, 1, j, f"w{j}") for j in range(60)] , "video_id long, idx int, j long, w string")
    words = [f"w{j}" for j in range(60)]
    heard = words[:10] + words[13:] + words[10:13]  # three words heard at the end instead
    heard = spark.createDataFrame([(7, i, w, i * 100, i * 100 + 90) for i, w in enumerate(heard)], "video_id long, i long, w string, start_ms long, end_ms long")
    got = {r.j: r.i for r in N.word_anchors(written, heard).collect()}
    assert set(got) == set(range(60)) - {10, 11, 12} and all(got[j] == j - 3 for j in range(13, 60))


def test_best_pairing_by_force(spark):
    rng = random.Random(6)
    cells = {(g, a, b): rng.randrange(51, 101) for g in range(40) for a in range(5) for b in range(5) if rng.random() < 0.5}
    df = spark.createDataFrame([(g, g % 3, a, b, s) for (g, a, b), s in cells.items()], "video_id long, region long, a long, b long, score long").repartition(4)
    got = {}
    for r in Q.best_pairing(df, ["video_id", "region"]).collect():
        got.setdefault(r.video_id, []).append((r.a, r.b, r.score))
    for g in {g for g, _, _ in cells}:
        own = [(a, b, s) for (x, a, b), s in cells.items() if x == g]
        rises = lambda c: all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:]))
        most = max(sum(x[2] for x in c) for n in range(1, 6) for c in itertools.combinations(sorted(own), n) if rises(c))
        assert rises(sorted(got[g])) and sum(x[2] for x in got[g]) == most


def propagated(spark, old, new, paragraphs=None):
    make = lambda texts: spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "video_id long, idx int, text string")
    paras = make(paragraphs if paragraphs is not None else old).withColumnRenamed("idx", "para_idx")
    return Y.propagate(make(old), make(new), paras).first()


def test_crossed_pairs_are_refused(spark):
    """Two blocks that swap places with an edit each: one pair keeps the order, the other is removed and inserted."""
    a, b = "the quick brown fox jumps over the dog today", "a slow green turtle walks under one bridge now"
    r = propagated(spark, ["start", a, b, "gone for good now", "end"], ["start", b + " x", a + " y", "end"])
    assert (r.changed, r.removed, r.inserted) == (1, 2, 1)


def test_standing_phrases_by_force(spark):
    rng = random.Random(7)
    texts = [(v, i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for v in range(8) for i in range(4)]
    phrases = [(v, " ".join(rng.choice("abcd") for _ in range(n))) for v in range(9) for n in range(0, 7) for _ in range(4)]
    df = spark.createDataFrame(texts, "video_id long, para_idx int, text string")
    got = {(r.video_id, r.text) for r in Y.standing(spark.createDataFrame(phrases, "video_id long, text string"), df).collect()}
    whole = {v: " " + " ".join(t for x, _, t in texts if x == v and t) + " " for v in range(9)}
    assert got == {(v, p) for v, p in phrases if not p or f" {p} " in whole[v]}


def test_fragments_of_any_length_are_found(spark):
    rng = random.Random(8)
    cues = [(v, i, "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 14)))) for v in range(5) for i in range(12)]
    frags = [(v, p, "".join(rng.choice("ab ") for _ in range(p % 6))) for v in range(6) for p in range(24)]
    c = spark.createDataFrame(cues, "video_id long, idx int, cue string")
    f = spark.createDataFrame(frags, "video_id long, para_idx int, old_part string")
    met = Y.holding(f, c).where(F.instr("cue", F.col("old_part")) > 0)
    want = {(v, p, i) for v, p, o in frags if o for w, i, t in cues if v == w and o in t}
    assert {(r.video_id, r.para_idx, r.idx) for r in met.collect()} == want


def test_rows_without_an_end_in_sight_meet_all_they_overlap(spark):
    left = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 10**12), (2, 1, 0, 5)], "video_id long, idx int, start_ms long, end_ms long")
    right = spark.createDataFrame([(1, 3, 7, "a"), (1, 10**9, 10**12, "b"), (2, 2, 3, "c"), (3, 0, 10**12, "d")], "video_id long, r_start long, r_end long, w string")
    got = sorted((r.video_id, r.idx, r.w) for r in A.interval_join(left, right).collect())
    assert got == [(1, 1, "a"), (1, 2, "a"), (1, 2, "b"), (2, 1, "c")]
