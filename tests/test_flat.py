"""Kernels on flat arrays of many videos: odd texts against the SQL, small slices against large ones, and plans that shuffle texts once."""

import itertools
import random

import numpy as np
import pytest
from oracle import compare, connect

from cuegrain import views as V
from cuegrain.operators import carry as R
from cuegrain.operators import edits as E
from cuegrain.operators import flat as K
from cuegrain.operators import snap as N
from cuegrain.plans.all import ORACLES, PLANS

WORDS = ["a", "b", "c", "d'", "É", "é", "ΟΔΟΣ", "οδος", "οδοσ", "İx", "ix", "²", "x_y", "日本", "-", "", "\t", "\r", "\x0b", "Mr.", "so,", "and", "of", "end.", "Go!", "longerword", "(w)"]
ONCE = {"c4_snap_to_speech": 1, "j16_word_times_for_cues": 1, "c7_carry_timing": 2, "c7_carry_counts": 2, "c5_align_translation": 2}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(12)
    text = lambda n, k: "".join(rng.choice(WORDS[:k] if rng.random() < 0.7 else [f"w{rng.randrange(60)}"]) + rng.choice([" "] * 12 + ["  ", "\n", "\t", ". A ", ".\n"]) for _ in range(n))
    texts = ["", " ", None, "\n\n", "a", "a b c", "ΟΔΟΣ x y. Go ΟΔΟΣ x z οδοσ x y", "w " * 300, "-- -- --\n- - -", "one two three four. " * 4]
    texts += [text(rng.randrange(1, 160), rng.choice([9, len(WORDS)])) for _ in range(150)]
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [*ONCE, "j25_pair_boundary", "w31_blocks_from_paragraphs", "f9_split_to_width"])
@pytest.mark.parametrize("size", [1, 8_000_000])
def test_odd_texts_against_sql(spark, odd, monkeypatch, name, size):
    """Whether a kernel takes one video at a time or all. Before, a capital sigma at a word's end was not the small one that the SQL makes of it."""
    monkeypatch.setattr(K, "SLICE", size)
    assert compare(PLANS[name](spark, odd), connect(odd), ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(ONCE))
def test_texts_are_shuffled_once(spark, small, name):
    """Texts of cues, and of blocks or paragraphs beside them. Before, words went through functions that are interpreted word by word, and cues were dealt by video and number."""
    df = PLANS[name](spark, small)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "- Exchange " in line]
    assert len(dealt) == ONCE[name] and all("hashpartitioning(video_id#" in line and "idx#" not in line.split("ENSURE")[0] for line in dealt), plan
    assert "ArrowEvalPython" in plan and "lambda w_" not in plan, plan


def test_shared_triples_by_force():
    rng = np.random.default_rng(3)
    met = 0
    for size in (3, 4, 2**21):  # the last one takes keys over 63 bits
        x, y = (rng.integers(0, size, n) if size < 99 else rng.choice([0, 5, size - 1], n) for n in (300, 260))
        of_x, of_y = np.sort(rng.integers(0, 40, 300)), np.sort(rng.integers(0, 40, 260))
        want = []
        for v in range(40):
            at = [[tuple(w[i : i + 3].tolist()) for i in range(*np.searchsorted(of, [v, v + 1])) if i + 2 < len(w) and of[i + 2] == v] for w, of in ((x, of_x), (y, of_y))]
            first = [np.searchsorted(of, v) for of in (of_x, of_y)]
            want += [(first[0] + at[0].index(g), first[1] + at[1].index(g)) for g in at[0] if at[0].count(g) == 1 == at[1].count(g)]
        met += len(want)
        assert sorted(want) == list(zip(*(z.tolist() for z in K.shared(x, of_x, y, of_y)), strict=True))
    assert met > 20


def test_rising_by_force():
    rng = random.Random(4)
    values = [[rng.randrange(9) for _ in range(rng.randrange(1, 10))] for _ in range(80)]
    of = np.repeat(np.arange(80), [len(v) for v in values])
    keep = K.rising(np.array(list(itertools.chain(*values))), of)
    for v, own in enumerate(values):
        kept = list(itertools.compress(own, keep[of == v]))
        most = max(n for n in range(1, len(own) + 1) for c in itertools.combinations(own, n) if all(a < b for a, b in itertools.pairwise(c)))
        assert len(kept) == most and all(a < b for a, b in itertools.pairwise(kept))


def test_words_given_in_any_way(spark, odd):
    cues = V.cues(spark, odd)
    old, new = V.timecoded(cues), E.blocks(V.paragraphs(spark, odd)).select("video_id", "id", "text")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for made in (R.carry_timing, R.carry_counts):
        want = rows(made(old, new))
        assert want and all(rows(made(old, new, said)) == want for said in (V.words(cues), V.spoken(cues), V.voiced(cues)))
    want = rows(N.snap_to_speech(V.edited_cues(cues), V.words(cues)))
    assert want and all(rows(N.snap_to_speech(V.edited_cues(cues), said)) == want for said in (V.spoken(cues), V.voiced(cues)))
    # without words or blocks cues stay, and none is carried
    none = V.words(cues).limit(0)
    assert {r.matched for r in N.snap_to_speech(cues, none).collect()} == {False}
    assert {(r.after, r.splits, r.dropped - r.before) for r in R.carry_counts(old, new.limit(0)).collect()} == {(0, 0, 0)} and R.carry_timing(old, new.limit(0)).count() == 0
