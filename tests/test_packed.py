"""Videos as one row each: the pairs of once-said triples by brute force, and plans that shuffle texts, not words."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cuegrain.operators import align as A
from cuegrain.operators import packed as P

CUES = "video_id long, idx int, text string, start_ms long, end_ms long"


def versions(spark, seed=5):
    rng = random.Random(seed)
    old = [(v, i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 7))), i * 1000, i * 1000 + 900) for v in range(12) for i in range(rng.randrange(1, 12))]
    new = [(v, i, t if rng.random() < 0.7 else t + " z!", s, e) for v, i, t, s, e in old if rng.random() < 0.9]
    return old, new, spark.createDataFrame(old, CUES), spark.createDataFrame(new, CUES)


def once(rows, video):
    said = [("".join(ch for ch in w if ch.isalnum()), i) for v, i, t, *_ in sorted(rows) if v == video for w in t.split(" ")]
    said = [x for x in said if x[0]]
    found = [(tuple(w for w, _ in said[k : k + 3]), said[k][1]) for k in range(len(said) - 2)]
    many = Counter(g for g, _ in found)
    return {g: i for g, i in found if many[g] == 1}


def test_lineage_by_brute_force(spark):
    old, new, a, b = versions(spark)
    want = set()
    for v in range(12):
        x, y = once(old, v), once(new, v)
        want |= {(v, y[g], x[g]) for g in x.keys() & y.keys()}
    got = {(r.video_id, r.idx, o) for r in A.block_lineage(a, b).collect() for o in r.old_ids}
    assert want and got == want


def shuffles(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_words_are_not_shuffled(spark):
    """Before, words and triples were dealt anew by video and triple."""
    _, _, a, b = versions(spark)
    for df in (A.block_lineage(a, b), A.anchor_map(a, b), A.remap_cues(A.anchored(a, b))):
        plan = shuffles(df)
        assert len(plan) <= 2 and all("hashpartitioning(video_id" in line and "hashpartitioning(video_id#" in line and ", g#" not in line for line in plan), plan


def test_places_and_first_of_each(spark):
    df = spark.sql("select array(5L, null, 1L, 9L) t, array(1L, 5L, 7L) m, array(struct(2L as a, 1L as b), struct(1L as a, 3L as b), struct(2L as a, 0L as b)) p")
    r = df.select(P.places(F.col("t"), F.col("m")).alias("k"), P.first_of_each(F.col("p")).alias("p")).head()
    assert r.k == [1, None, 0, 3] and [tuple(x) for x in r.p] == [(1, 3), (2, 0)]


def test_words_in_rows_are_the_words(spark, small):
    from cuegrain import views as V
    from cuegrain.operators import snap as N

    cues = V.cues(spark, small).where("video_id < 40")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    spoken, words = V.spoken(cues), V.words(cues)
    assert rows(spoken.select("video_id", F.explode("heard").alias("h")).select("video_id", "h.*")) == rows(words)
    assert rows(A.pauses(spoken).select("video_id", "cue_idx", "w_pos", "ends", "pause_ms")) == rows(A.pauses(words))
    edited = V.edited_cues(cues)
    for made in (N.cue_times, N.pair_boundaries):
        assert rows(made(edited, spoken)) == rows(made(edited, words)) != []
        plan = shuffles(made(edited, spoken))
        # nothing is dealt by a triple, a word's number, an edge's time or a time bucket
        assert len(plan) <= 4 and not any(re.search(r"[(, ](g|i|j|t|_b)#", line) for line in plan), plan
