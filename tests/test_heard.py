"""Words of a video in its row: overlaps and silences by brute force; queries that do not deal or gather words."""

import random
import re

import pytest

from cuegrain.operators import align as A
from cuegrain.plans.all import PLANS

SPAN = "video_id long, idx int, start_ms long, end_ms long"
WORD = "video_id long, start_ms long, end_ms long"


def timed(seed, odd):
    rng = random.Random(seed)
    at = lambda n: (lambda a: (a, a + rng.randrange(-n if odd else 0, 40)))(rng.randrange(0, 300))
    spans = [(v, i, *at(30)) for v in range(10) for i in range(rng.randrange(0, 14))]
    words = [(v, *at(5)) for v in range(1, 12) for _ in range(rng.randrange(0, 30))]
    if odd:
        spans += [(3, 90, None, 5), (3, 91, 4, None)]
        words += [(3, None, 9), (4, 9, None), (5, 0, 10**9)]
    return spans, words


@pytest.mark.parametrize("odd", [False, True])
def test_words_and_silences_of_spans_by_force(spark, odd):
    """Before, spans and words were dealt by time bucket."""
    spans, words = timed(4 + odd, odd)
    a, b = spark.createDataFrame(spans, SPAN), spark.createDataFrame(words, WORD)

    def near(span, closed):
        v, _, s, e = span
        known = [(x, y) for u, x, y in words if u == v and None not in (x, y)] if None not in (s, e) else []
        return sorted((x, y) for x, y in known if (y >= s and x <= e if closed else y > s and x < e))

    def silence(span):
        got, most, reached = near(span, False), 0, span[2]
        for i, (x, y) in enumerate(got):
            x, y = max(x, span[2]), min(y, span[3])
            most = max(most, x - reached)
            reached = y if i == 0 else max(reached, y)
        return max(most, span[3] - reached) if got else 0

    told = {(r.video_id, r.idx): (r.speech_start, r.speech_end, r.n_words) for r in A.speech_span(a, b).collect()}
    for s in spans:
        got = near(s, True)
        assert told.pop(s[:2]) == ((got[0][0], max(y for _, y in got), len(got)) if got else (s[2], s[3], 0)), s
    assert not told
    assert {(r.video_id, r.idx): r.silence_ms for r in A.longest_silence(a, b).collect()} == {s[:2]: silence(s) for s in spans}
    gaps = {}
    for s, t in zip(spans, spans[1:]):
        if s[0] == t[0] and None not in (s[3], t[2]):
            x, y = near(s, False), near(t, False)
            gap = t[2] - s[3]
            gaps[s[:2]] = max(gap, y[0][0] - max(z for _, z in x)) if x and y else gap
    assert {(r.video_id, r.idx): r.gap_ms for r in A.speech_gap(a, b).collect()} == gaps
    for made in (A.speech_span(a, b), A.speech_gap(a, b), A.longest_silence(a, b)):
        assert "_b#" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j2_words_in_cue", "w16_speech_gap", "w17_longest_silence", "s2_read_speech_words", "s2_read_speech_segments", "s12_read_word_blocks", "a17_word_alignment_contract", "k4_export_timing", "u3_word_edges"])
def test_words_are_not_gathered(spark, small, name):
    """Before, words became rows that were sorted and collected again."""
    plan = PLANS[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Generate posexplode.*w_pos#", plan), plan
