"""Token streams of awkward pages, shapes of names, merging to a fixpoint, long lines."""

import time

import pytest
from pyspark.sql import functions as F

from cuegrain.operators import cues as C
from cuegrain.operators import edits as E
from cuegrain.operators import html as H
from cuegrain.operators import talks as T

BOX, FRAME = '<div class="embedded-video-wrapper">', '<iframe src="https://player.vimeo.com/video/{}"></iframe>'
INFO = '<div class="video-meta-info">2001-02-03 {}, Rome</div>'


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def lines_of(spark, html):
    return [r.line for r in H.page_lines(pages(spark, html)).orderBy("pos").collect()]


def videos_of(spark, html):
    return [(r.title, r.slug, int(r.link.rsplit("/", 1)[1])) for r in T.page_videos(pages(spark, html)).orderBy("pos").collect()]


def test_lines_of_awkward_pages(spark):
    assert lines_of(spark, "<p>a<b>b</b></p>c<br>d &amp;lt; e") == ["ab", "c", "d &lt; e"]
    assert lines_of(spark, "<p>kept</p><script>if (a < b) { never closed") == ["kept"]
    assert lines_of(spark, "<p>kept</p><!-- never closed <p>gone</p>") == ["kept"]
    assert lines_of(spark, "1 < 2 and a lone <") == ["1 < 2 and a lone <"]
    assert lines_of(spark, f"<p>a</p>{BOX}<div>x<div>y</div></div>{FRAME.format(1)}</div><p>b</p>") == ["a", "b"]
    assert lines_of(spark, f"<p>a</p>{BOX}<p>inside, never closed</p>") == ["a"]
    assert lines_of(spark, f"</div></div><p>a</p>{BOX}x</div>b{BOX}{BOX}y</div>z</div>c") == ["a", "b", "c"]
    assert lines_of(spark, "") == [] and lines_of(spark, None) == []


def test_players_in_boxes(spark):
    assert videos_of(spark, BOX + INFO.format("Talk") + "<div><div>" + FRAME.format(7) + "</div></div></div>") == [("Talk", "Talk", 7)]
    # a box without a player counts, and neither takes the next one's player nor lends it its label
    assert videos_of(spark, BOX + INFO.format("Talk") + "</div>" + BOX + FRAME.format(8) + "</div>") == [("Video 2", "Video-2", 8)]
    # a box in a box: both hold the inner one's player
    assert videos_of(spark, BOX + BOX + INFO.format("In") + FRAME.format(1) + "</div>" + FRAME.format(2) + "</div>") == [("In", "In", 1), ("In", "In-2", 1)]
    # no box has a player: the frames count, with the heading right before
    assert videos_of(spark, BOX + "</div><h3>Morning</h3> " + FRAME.format(3) + "<p>x</p>text" + FRAME.format(4)) == [("Morning", "Morning", 3), ("Video 2", "Video-2", 4)]
    assert videos_of(spark, "<script>" + FRAME.format(3)) == [] and videos_of(spark, None) == []


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (T.valid_talk_id, ["2001-02-03_A.b-c_d"], ["2001-02-03_", "2001-02-03_a/b", "2001-02-03_a\n", "x2001-02-03_a", "2001-02-03_" + "a" * 81, None]),
        (T.valid_slug, ["Talk-1", "_x.y"], ["-rf", ".", "..", "a b", "a\n", "a" * 65, "", None]),
        (T.valid_link, ["https://vimeo.com/12", "https://www.vimeo.com/12/0af/", "https://player.vimeo.com/video/12"], ["http://vimeo.com/12", "https://vimeo.com/12/xyz", "https://evil.com/vimeo.com/12", "https://vimeo.com/12?x", None]),
        (T.valid_ref, ["main", "sync/user/t--s-uk", "v1.2"], ["-x", "a..b", "a//b", "a/", "a b", "a\n", "", None]),
    ],
)
def test_shapes_of_names(spark, check, good, bad):
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert {r.v for r in df.where(check(F.col("v"))).collect()} == set(good)


def test_merging_stops_when_nothing_is_left(spark):
    """Eight one-word cues need three passes, and others that fit nowhere none."""
    words = [(1, i, i * 300, i * 300 + 250, f"w{i}") for i in range(1, 9)]
    long = [(2, i, i * 9000, i * 9000 + 4000, "a sentence of a fair length that stands alone") for i in range(1, 4)]
    cues = spark.createDataFrame(words + long, "video_id long, idx int, start_ms long, end_ms long, text string")
    got = {(r.video_id, r.idx): (r.start_ms, r.end_ms, r.text, r.parts) for r in C.merge_short(cues).collect()}
    assert got[1, 1] == (300, 2650, " ".join(f"w{i}" for i in range(1, 9)), 8) and len(got) == 4
    once = C.merge_short(cues, passes=1).where("video_id = 1").collect()
    assert sorted(r.parts for r in once) == [2, 2, 2, 2]
    assert C.merge_short(cues.limit(0)).count() == 0


def test_a_very_long_line_is_split_in_time(spark):
    text = " ".join(f"w{i % 1000}" for i in range(200_000))
    split = lambda t: spark.createDataFrame([(t,)], "t string").select(E.split_to_width(F.col("t")).alias("p")).first().p
    split(text[:5000])  # compiles the plan
    began = time.time()
    parts = split(text)
    assert time.time() - began < 10 and " ".join(parts) == text and max(map(len, parts)) <= 84


def test_splits_at_the_middle_of_wide_texts_by_force(spark):
    rows = [("x" * 200,), ("x" * 100 + " " + "y" * 10 + " " + "z" * 90,), (" ".join("ab" for _ in range(80)),), ("x" * 90 + " " + "y" * 200,), ("é " * 100 + "é",)]
    for r in spark.createDataFrame(rows, "t string").select("t", E.split_once(F.col("t")).alias("p")).collect():
        at = [i for i, c in enumerate(r.t) if c == " "]
        best = min(at, key=lambda i: (abs(2 * i - len(r.t)), i), default=None)
        assert r.p == ([r.t[:best], r.t[best + 1 :]] if at else [r.t])
