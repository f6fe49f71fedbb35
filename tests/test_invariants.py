"""What must hold for any cues: repairs are idempotent, never overlap, keep text; closed forms equal loops."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrain.functions import text as T
from cuegrain.operators import align as A
from cuegrain.operators import cues as C
from cuegrain.operators import merge as M


@pytest.fixture(scope="module")
def cues(spark):
    rng = random.Random(11)
    rows = []
    for v in range(40):
        t = rng.randrange(3000)
        for i in range(1, rng.randrange(2, 30)):
            d = rng.randrange(200, 9000)
            rows.append((v, i, t, t + d, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12)))))
            t += max(1, d + rng.randrange(-1500, 3000))
    return spark.createDataFrame(rows, "video_id long, idx int, start_ms long, end_ms long, text string").cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


TIMES = ("video_id", "idx", "start_ms", "end_ms")


@pytest.mark.parametrize("fix", [C.trim_overlaps, C.structural_gap_fix, C.chain_gaps, C.snap_trim, C.min_duration_floor])
def test_repairs_are_idempotent(cues, fix):
    once = fix(cues)
    assert rows(once, *TIMES) == rows(fix(once), *TIMES)


def test_trimmed_cues_do_not_overlap(cues):
    gaps = C.with_gaps(C.trim_overlaps(cues)).where("gap_ms < 80")
    assert gaps.count() == 0


def test_padding_never_passes_the_next_cue(cues):
    padded = C.with_gaps(C.pad_into_silence(C.trim_overlaps(cues)))
    assert padded.where("gap_ms < 80").count() == 0


def test_merging_keeps_every_word(cues):
    words = lambda df: df.select("video_id", F.explode(F.split("text", " ")).alias("w")).groupBy("video_id").agg(F.count("*").alias("n"))
    assert rows(words(cues), "video_id", "n") == rows(words(C.merge_short_pairs(cues)), "video_id", "n")


def test_zero_offset_is_identity(spark, cues):
    zero = cues.select("video_id").distinct().withColumn("offset_ms", F.lit(0))
    assert rows(C.shift_timeline(cues, zero), *TIMES) == rows(cues, *TIMES)


def test_time_round_trip(spark):
    ms = [0, 1, 999, 1000, 3_599_999, 3_600_000, 360_000_123]
    df = spark.createDataFrame([(m,) for m in ms], "t long")
    assert [r[0] for r in df.select(T.timecode_to_ms(T.ms_to_timecode(F.col("t")))).collect()] == ms


def test_monotone_is_the_loop(spark):
    rng = random.Random(2)
    points = [(v, p, rng.randrange(1000)) for v in range(5) for p in range(50)]
    want = []
    for v in range(5):
        top = None
        for _, p, s in (x for x in points if x[0] == v):
            if top is None or s >= top:
                want.append((v, p, s))
                top = s
    got = A.monotone(spark.createDataFrame(points, "video_id long, p long, s long"))
    assert rows(got, "video_id", "p", "s") == want


def test_proportional_text_is_the_loop(spark):
    rng = random.Random(3)
    segs, texts, want = [], [], []
    for v in range(30):
        weights = [rng.randrange(0, 9) for _ in range(rng.randrange(1, 8))]
        words = [f"w{i}" for i in range(rng.randrange(0, 25))]
        segs += [(v, i, w) for i, w in enumerate(weights)]
        texts.append((v, " ".join(words)))
        cum, pos, total = 0, 0, max(1, sum(weights))
        for i, w in enumerate(weights):
            cum += w
            end = len(words) if i == len(weights) - 1 else max(round(len(words) * (cum / total)), pos + 1)
            want.append((v, i, " ".join(words[pos:end])))
            pos = end
    got = A.proportional_text(spark.createDataFrame(segs, "video_id long, i long, weight long"), spark.createDataFrame(texts, "video_id long, text string"))
    assert rows(got, "video_id", "i", "text") == sorted(want)


def test_remap_is_monotone_and_identity_on_itself(spark):
    anchors = spark.createDataFrame([(1, p, p) for p in range(1000, 9000, 700)], "video_id long, p long, s long")
    points = spark.createDataFrame([(1, str(t), t) for t in range(0, 12000, 137)], "video_id long, id string, t long")
    got = [r for r in A.remap(points, anchors).orderBy("t").collect() if r.mapped is not None]
    assert all(r.mapped == r.t for r in got) and min(r.t for r in got) == 0 and max(r.t for r in got) <= 8700 + 2000


def test_typography_is_stable(spark):
    texts = ['"a" b', 'he said "x "y" z"', "- a - b", "it's", "a ...", "„q”", "a-b", "—", '""x""']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(T.typography(F.col("t")).alias("t"))
    assert once.collect() == once.select(T.typography(F.col("t")).alias("t")).collect()
    assert [r.t for r in once.collect()][:3] == ["«a» b", "he said «x «y» z»", "– a – b"]


def test_hygiene_finds_nothing_after_fix(spark):
    dirty = ["a\r\nb", "a b", "a\u200bb", "x ... y", '"q" — it\'s', "\ufefft", "a\u200db", "क्\u200dष"]
    df = spark.createDataFrame([(t,) for t in dirty], "t string")
    left = df.select(T.hygiene(T.fix_document(F.col("t"), F.lit(True)), F.lit(True)).alias("h")).where(F.size("h") > 0)
    assert left.count() == 0


def test_merge_of_one_sided_changes(spark):
    e = [("base", 1, 1, "a"), ("local", 1, 1, "b"), ("remote", 1, 1, "a"), ("base", 1, 2, "a"), ("local", 1, 2, "a"), ("base", 1, 3, "x"), ("local", 1, 3, "y"), ("remote", 1, 3, "z")]
    got = {r.turn: (r.v, r.deleted) for r in M.three_way_merge(spark.createDataFrame(e, "snapshot string, conv_id long, turn long, v string")).collect()}
    assert got == {1: ("b", False), 2: (None, True), 3: ("y", False)}


def test_long_intervals_are_not_dealt(spark):
    """One corrupt end time of 10**12 ms meets what it overlaps, on either side, without a row for each bucket."""
    from cuegrain.operators.align import interval_join

    left = [(1, 1, 0, 5_000), (1, 2, 6_000, 10**12), (1, 3, 20_000, 30_000), (2, 1, 0, 10**12)]
    right = [(1, 0, 4_000, "a"), (1, 7_000, 10**12, "b"), (1, 25_000, 26_000, "c"), (2, 5, 10**12, "d"), (3, 0, 1, "e")]
    a = spark.createDataFrame(left, "video_id long, idx int, start_ms long, end_ms long")
    b = spark.createDataFrame(right, "video_id long, r_start long, r_end long, name string")
    got = sorted((r.video_id, r.idx, r.name) for r in interval_join(a, b).collect())
    assert got == sorted((v, i, n) for v, i, s, e in left for w, x, y, n in right if v == w and s < y and e > x)


def test_split_to_width_leaves_nothing_wide(spark):
    from pyspark.sql import functions as F

    from cuegrain.operators import edits

    texts = [" ".join(["ab"] * 3000), "x" * 300 + " y", ("z" * 90 + " ") * 40 + "end", "short"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", edits.split_to_width(F.col("t")).alias("p")).collect()
    for r in rows:
        assert " ".join(r.p) == r.t.strip() and all(len(x) <= 84 or " " not in x for x in r.p)


def test_quotes_after_many_marks_without_width(spark):
    from pyspark.sql import functions as F

    from cuegrain.functions import text as T

    rows = [('a "' + "\u200b" * 50 + '"b"', "a «" + "\u200b" * 50 + "«b»"), ('"x" - y ...', "«x» – y..."), ('("q")', "(«q»)"), ("a - - b", "a – – b")]
    got = spark.createDataFrame(rows, "t string, want string").select(T.typography(F.col("t")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]
    joiners = [("क\u200dx", "क\u200dx"), ("x\u200dy", "xy"), ("क\u200d\u200d\u200dx", "क\u200dx"), ("क\u200d\u200dक", "क\u200d\u200dक"), ("\u200dक", "\u200dक")]
    got = spark.createDataFrame(joiners, "t string, want string").select(T.clean_invisible(F.col("t")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_split_points(spark):
    """Block and line splits against a plain loop."""
    import re

    from pyspark.sql import functions as F

    from cuegrain.operators import splits

    def block(t):
        mid = len(t) // 2
        for mark in ("[.!?]", "[,;:—]"):
            places = [m.end() for m in re.finditer(mark + r"\s", t)]
            if places:
                return min(places, key=lambda p: (abs(p - mid), p))
        spaces = [i + 1 for i, c in enumerate(t) if c == " " and i + 1 >= mid]
        return spaces[0] if spaces else None

    texts = ["One. Two. Three", "a, b; c d", "no marks in here at all", "word", "", "x" * 50 + " " + "y" * 50, "Ends. ", "a. bbbbbbbbbb cc, dd", "One two three four, five six seven and eight nine ten eleven twelve thirteen fourteen fifteen"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", splits.block_split(F.col("t")).alias("b"), splits.line_split(F.col("t")).alias("l")).collect()
    for r in rows:
        assert r.b == block(r.t), r.t
        assert (r.l is None) == (len(r.t) <= 84 or " " not in r.t) and (r.l is None or r.t[r.l] == " ")


def test_edit_documents_round_trip(spark, small):
    from cuegrain.operators import talks
    from cuegrain.plans.talk_plans import edit_docs

    leaves = talks.flatten_doc(edit_docs(spark, small))
    again = talks.unflatten_doc(leaves)
    entries = again.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "entry")))).alias("doc"))
    twice = talks.flatten_doc(entries)
    assert leaves.exceptAll(twice).count() == 0 and twice.exceptAll(leaves).count() == 0


def test_manifests_are_read_back(spark, tmp_path):
    from cuegrain.operators import talks

    derived = spark.createDataFrame([(1, "secondary-offset", "Main"), (2, "secondary-resync", "Main")], "video_id long, mode string, primary_slug string")
    files = talks.manifest_files(derived, "7")
    talks.write_manifests(files, str(tmp_path / "m"))
    back = spark.read.text(str(tmp_path / "m"), wholetext=True).withColumnRenamed("value", "file")
    got = {r.video_id: (r.role, r.mode, r.primary_slug) for r in talks.parse_manifests(back.select("video_id", "file")).collect()}
    assert got == {1: ("secondary", "secondary-offset", "Main"), 2: ("secondary", "secondary-resync", "Main")}
