"""Work on one row a video: by brute force, and by plans that deal videos, not words or runs of words."""

import random
import re

from pyspark.sql import functions as F

from cuegrain.operators import align as A
from cuegrain.operators import edits as E
from cuegrain.operators import sync as Y

CUES = "video_id long, idx int, text string, start_ms long, end_ms long"


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "Broadcast" not in line]


def dealt_by_video(df):
    """Whether whatever is shuffled is dealt by the video alone."""
    return all("hashpartitioning(video_id#" in line and not re.search(r"hashpartitioning\(video_id#\d+L?, [a-z_]+#", line) for line in exchanges(df))


def two_versions(seed=3):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice("abcD,") for _ in range(rng.randrange(1, 9)))
    old = [(v, i, rng.choice(["a b c d", "", None]) if rng.random() < 0.2 else text()) for v in range(8) for i in range(rng.randrange(0, 25))]
    new = [(v, i, t if rng.random() < 0.6 or t is None else t + " a") for v, i, t in old if rng.random() < 0.9]
    return old, new


def test_similar_blocks_by_force(spark):
    """Before, words of repeated lines met pair by pair."""
    old, new = two_versions()

    def grams(t):
        w = ["".join(c for c in x if c.isalnum()) for x in t.lower().split(" ")]
        return {" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))}

    for share in (50, 20, 99):
        want = set()
        for v in range(8):
            scores = {}
            for _, i, t in (r for r in old if r[0] == v and r[2] is not None):
                for _, j, u in (r for r in new if r[0] == v and r[2] is not None):
                    c = len(grams(t) & grams(u))
                    s = c * 100 // len(grams(t) | grams(u))
                    if s > share:
                        scores[i, j] = s
            first = {i: min((-s, b) for (a, b), s in scores.items() if a == i) for i in {a for a, _ in scores}}
            last = {j: min((-s, a) for (a, b), s in scores.items() if b == j) for j in {b for _, b in scores}}
            want |= {(v, i, first[i][1], -first[i][0]) for i in first if last[first[i][1]][1] == i}
        made = E.similar_blocks(spark.createDataFrame(old, "video_id long, idx int, text string"), spark.createDataFrame(new, "video_id long, idx int, text string"), share)
        assert {tuple(r) for r in made.collect()} == want != set()
    assert dealt_by_video(made), exchanges(made)


def test_phrases_stand_out_of_order(spark):
    """Before, words and runs of words of the texts were dealt by video and run."""
    rng = random.Random(9)
    words = [rng.choice("abc") for _ in range(900)]
    said = " ".join(words)
    phrases = [" ".join(words[i : i + n]) for i, n in ((880, 7), (3, 9), (500, 1), (400, 400), (20, 2))] + ["c d", "d", "", None, "a " * 50 + "d", said, said + " a", said[2:]]
    got = spark.createDataFrame([(phrases, said), (["", "a", None], None)], "p array<string>, t string").select(Y.stand(F.col("p"), F.col("t")).alias("s")).collect()
    assert list(got[0].s) == [p is not None and (p == "" or f" {p} " in f" {said} ") for p in phrases]
    assert list(got[1].s) == [True, False, False]
    texts = spark.createDataFrame([(1, 0, said)], "video_id long, para_idx int, text string")
    asked = spark.createDataFrame([(1, p) for p in phrases], "video_id long, text string")
    assert dealt_by_video(Y.versions(asked.withColumn("idx", F.lit(0)), asked.withColumn("idx", F.lit(0)), texts))


def test_changed_cues_are_dealt_by_video(spark):
    old, new = two_versions()
    make = lambda rows: spark.createDataFrame(rows, "video_id long, idx int, text string")
    made = Y.open_cues(Y.versions(make(old), make(new), make(old).withColumnRenamed("idx", "para_idx")))
    assert len(exchanges(made)) == 1 and dealt_by_video(made), exchanges(made)
    assert {r.video_id for r in made.collect()} == {v for v, _, _ in old + new}


def test_segments_do_not_carry_the_words_of_their_text(spark):
    """Before, each segment went through sorts and windows with all words of its video."""
    segs = spark.createDataFrame([(1, i, 1) for i in range(4)] + [(2, 0, 3)], "video_id long, i long, weight long")
    texts = spark.createDataFrame([(1, "a b\tc d e"), (2, None)], "video_id long, text string")
    made = A.proportional_text(segs, texts)
    assert sorted(map(tuple, made.collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c d"), (1, 3, "e"), (2, 0, "")]
    assert not re.search(r"size\(words#", made._jdf.queryExecution().optimizedPlan().toString())
