"""Fragments placed in cues in one row a video: odd texts against the SQL, and by brute force; plans that deal no text anew."""

import random

import pytest
from oracle import compare, connect

from cuegrain.operators import edits as E
from cuegrain.operators import sync as Y
from cuegrain.plans.all import ORACLES, PLANS
from pyspark.sql import functions as F

PIECES = ["Ab cd. Ef", "gh", "  ", "\t", "\x0b", "\f", "Mr. X said. \"No.\" He", "é ñ", "日本。", "Ä.", "a", "x y z! Go", "\r", "\n", "\n\n", "longer words here, and there. Then more"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(9)
    texts = ["\n".join(["one", "two", "ab\x0b cd"]), "a\n\t\nb\n\t", None, "", "\t\n\t\n\t", "Hello you. Good\nof it. So\nEnd here. Go on\nlast one"]
    texts += ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["j17_paragraph_diff", "j18_minimal_edit_fragment", "j19_locate_fragment", "j20_apply_text_edit"])
def test_odd_texts_against_sql(spark, odd, name):
    """Before, a fragment of a paragraph without a word stopped the job where the paragraph before had one."""
    assert compare(PLANS[name](spark, odd), connect(odd), ORACLES[name]) > 0


def test_edits_without_a_place_by_force(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    cues = [(v, i, text(rng.randrange(0, 14))) for v in range(5) for i in range(9)]
    frags = [(v, p, text(p % 6), "N", 0, rng.choice([None, p % 11]), rng.choice([None, 0, 2, -1])) for v in range(6) for p in range(30)]
    c = spark.createDataFrame(cues, "video_id long, idx int, text string").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("cues"))
    f = spark.createDataFrame(frags, "video_id long, para_idx int, old_part string, new_part string, at int, idx int, offset int")
    rows = f.groupBy("video_id").agg(F.collect_list(F.struct(*f.columns[1:])).alias("fragments")).join(c, "video_id", "left")
    want = {}
    for v, p, old, new, _, idx, at in frags:
        mine = {i: t for w, i, t in cues if w == v}
        cue, hits = mine.get(idx), [i for i, t in mine.items() if old in t]
        if old == "":
            want[v, p] = "nothing to find", idx, None
        elif cue is not None and at is not None and at >= 0 and cue[at : at + len(old)] == old:
            want[v, p] = "located", idx, cue[:at] + new + cue[at + len(old) :]
        elif cue is not None and old in cue:
            want[v, p] = "right cue", idx, cue.replace(old, new, 1)
        else:
            want[v, p] = ("only one", hits[0], mine[hits[0]].replace(old, new, 1)) if len(hits) == 1 else ("ambiguous" if hits else "not found", None, None)
    assert {(r.video_id, r.para_idx): (r.result, r.idx, r.text) for r in Y.apply_edits(rows).collect()} == want
    assert {w[0] for w in want.values()} == {"nothing to find", "located", "right cue", "only one", "ambiguous", "not found"}


def test_twice_numbered_paragraphs_meet_each_other(spark):
    old = [(1, 0, "a"), (1, 0, "b"), (2, 0, "a"), (2, 1, "b"), (3, 0, "a"), (4, 0, "x"), (None, 0, "a")]
    new = [(1, 0, "a"), (1, 0, "c"), (2, 0, "a"), (3, 5, "a"), (5, 0, "x"), (None, 0, "b")]
    make = lambda rows: spark.createDataFrame(rows, "video_id long, para_idx int, text string")
    got = sorted(map(tuple, E.paragraph_diff(make(old), make(new)).collect()), key=repr)
    assert got == [(1, 0, "a", "c", None), (1, 0, "b", "a", None), (1, 0, "b", "c", None), (2, None, None, None, "count")]


def test_texts_are_dealt_by_video_only(spark, small):
    """Before, texts were dealt by paragraph, by cue and by bucket of word numbers."""
    for name in ("j17_paragraph_diff", "j19_locate_fragment", "j20_apply_text_edit"):
        plan = PLANS[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        lines = [line for line in plan.splitlines() if " Exchange " in line]
        assert "_b#" not in plan and all("hashpartitioning(video_id#" in line and "idx#" not in line.split("ENSURE")[0] for line in lines), plan


def test_edited_videos_by_force(spark, small):
    """Before, all cues of both versions were dealt by their texts, and each query compared the paragraphs twice."""
    rng = random.Random(11)
    old = [(v, rng.randrange(4), rng.choice(["a", "b", None])) for v in list(range(60)) + [None] for _ in range(rng.randrange(1, 5))]
    new = [r for r in old if rng.random() < 0.9] + [(v, 9, "z") for v in range(80)]
    make = lambda rows: spark.createDataFrame(rows, "video_id long, idx int, text string").repartition(3)
    got = [r.video_id for r in E.edited_videos(make(old), make(new)).collect()]
    want = {r[0] for r in set(old) - set(new)}
    assert len(got) == len(want) and set(got) == want != {r[0] for r in old}
    for name in ("a11_changed_talks", "c8_sync_review"):
        plan = PLANS[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert all(" text#" not in line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if " Exchange hashpartitioning" in line), name
