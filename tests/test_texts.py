"""Texts of a video in its row: words held against each other by brute force, and plans that shuffle no words."""

import random
import re

from cuegrain import views as V
from cuegrain.operators import align as A
from cuegrain.operators import quality as Q
from cuegrain.operators import validate as K
from cuegrain.plans.all import PLANS


def shuffles(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_words_place_by_place_by_force(spark):
    """Before, every word was a row that was shuffled twice."""
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["a", "B", "b", "", "\t", "é\n"]) for _ in range(rng.randrange(1, 5)))
    old = [(v, i, text()) for v in range(60) for i in range(rng.randrange(0, 3))] + [(98, 0, "\t"), (97, 3, "x"), (97, 1, "y")]
    new = [(v, i, t.upper() if rng.random() < 0.8 else text()) for v, i, t in old if rng.random() < 0.9 and v != 98] + [(96, 1, "z"), (98, 1, None), (95, 1, None)]
    said = lambda rows, v: [w for _, i, t in sorted(r for r in rows if r[0] == v and r[2]) for w in re.split("[ \t\n]+", t.lower()) if w]
    want = {}
    for v in {r[0] for r in old + new}:
        x, y = said(old, v), said(new, v)
        if x or y:
            at = next((i for i in range(max(len(x), len(y))) if x[i : i + 1] != y[i : i + 1]), None)
            want[v] = (len(x), len(y), at, None if at is None else "missing" if at >= len(y) else "extra" if at >= len(x) else "diff", at is None)
    made = A.text_preservation(spark.createDataFrame(old, "video_id long, para_idx int, text string"), spark.createDataFrame(new, "video_id long, idx int, text string"))
    assert {r.video_id: tuple(r)[1:] for r in made.collect()} == want
    assert {w[3] for w in want.values()} == {None, "missing", "extra", "diff"}
    assert all("hashpartitioning(video_id#" in line and ", pos#" not in line for line in shuffles(made))


def test_stats_shuffle_no_text(spark):
    """Before, the window of the gaps took whole cues."""
    cues = spark.range(9).selectExpr("id % 3 video_id", "cast(id as int) idx", "repeat('a', cast(id as int)) text", "id * 1000 start_ms", "id * 1000 + 900 end_ms")
    plan = Q.video_stats(cues.repartition(2))._jdf.queryExecution().executedPlan().toString()
    # a plan is printed from its end
    assert plan.index("Exchange") < plan.index("replace(text"), plan


def test_verdicts_deal_no_words(spark, small):
    assert not any(re.search(r"[(, ]pos#", line) for line in shuffles(PLANS["a3_validate_corpus"](spark, small)))


def test_missing_ids_make_no_rows_of_cues(spark, small):
    """Before, all ids of both sides were rows in the memory of a task, sorted by video and hashed by id."""
    rows = lambda rows: spark.createDataFrame(rows, "video_id long, ids array<int>")
    made = K.missing_ids(rows([(1, [3, 1, 2]), (2, [1]), (None, [1, 2]), (4, [])]), rows([(1, [2, 9]), (None, [2]), (5, [1])]))
    assert sorted(map(tuple, made.collect()), key=repr) == [(1, 1), (1, 3), (2, 1), (None, 1)]
    ids, cues = V.cue_ids(spark, small), V.cues(spark, small)
    told = lambda df: sorted(map(tuple, df.selectExpr("video_id", "explode(ids)").collect()))
    assert told(ids) == sorted(map(tuple, cues.select("video_id", "idx").collect())) != []
    assert told(V.timecode_ids(ids)) == sorted(map(tuple, V.timecodes(cues).select("video_id", "id").collect()))
    plan = PLANS["u1_missing_ids"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and all("hashpartitioning(video_id#" in line and "idx#" not in line for line in plan.splitlines() if "Exchange" in line), plan
