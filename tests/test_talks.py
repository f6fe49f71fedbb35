"""Metadata, manifests, headers and paths as they should not be."""

import json

from pyspark.sql import functions as F

from cuegrain.operators import talks as T


def violations(spark, *docs):
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    found = {}
    for r in T.metadata_contract(*T.parse_talks(spark.createDataFrame(rows, "talk_id long, json string"))).collect():
        found.setdefault(r.talk_id, set()).add(r.violation)
    return [found.get(i, set()) for i in range(len(docs))]


GOOD = {"title": "A talk", "date": "2001-02-03", "language": "en", "videos": [{"slug": "Part-1", "title": "One"}]}


def test_metadata_with_missing_keys_and_bad_json(spark):
    nothing = {"no title", "bad date", "bad language"}
    got = violations(
        spark, GOOD, {}, "", "{not json", None, "[]", {**GOOD, "title": None}, {**GOOD, "title": " \t"}, {**GOOD, "date": "3 Feb 2001"}, {**GOOD, "language": "EN"}, {**GOOD, "subtitle_omit": ["x", " "]},
        {**GOOD, "videos": []}, {**GOOD, "videos": [{}]}, {**GOOD, "videos": [{"slug": "a\n", "title": "t"}]}, {**GOOD, "videos": [{"slug": "A", "title": "t"}] * 2}, {**GOOD, "videos": [{"slug": "A", "title": "t", "vimeo_url": "https://x/1"}]},
        {**GOOD, "more": {"deep": [1]}},
    )
    assert got[0] == got[11] == got[16] == set()
    assert got[1] == got[2] == got[3] == got[4] == got[5] == nothing
    assert got[6] == got[7] == {"no title"} and got[8] == {"bad date"} and got[9] == {"bad language"} and got[10] == {"bad omit list"}
    assert got[12] == {"bad slug", "no video title"} and got[13] == {"bad slug"} and got[14] == {"duplicate slug"} and got[15] == {"plain link"}


def test_paths_of_both_kinds(spark):
    paths = {
        "talks/a/transcript_fr.txt": True, "talks\\a\\transcript_fr.txt": True, "fr.txt": True, "a\\b\\fr.srt": True, "a/en.srt": False, "a/x-fr-final.srt": True, "a/fr/en.srt": False, "a/FR.txt": False, "a/transcript_fr.txt.bak": False, "": False,
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.c for r in df.select("p", T.is_content_path(F.col("p"), "fr").alias("c")).collect()} == paths
    scanned = df.unionByName(spark.createDataFrame([("tests\\fixtures\\x.srt",), ("tests/fixtures/y",), ("tests/fixture",)], "p string")).where(~T.is_scanned_path(F.col("p")))
    assert {r.p for r in scanned.collect()} == {"tests\\fixtures\\x.srt", "tests/fixtures/y"}


def test_declared_languages(spark):
    lines = {"Talk Language: English, Marathi | x": ["en", "mr"], "Talk Language:": ["en"], "Talk Language: , ,": ["en"], "x Talk Language: French": ["en"], "a\nTalk Language: GERMAN\nb": ["de"], "Talk Language: Klingon": ["kl"], "": ["en"]}
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert {r.t: r.c for r in df.select("t", T.declared_languages(F.col("t")).alias("c")).collect()} == lines


def test_manifests_with_odd_lines(spark):
    files = [(1, "role: primary\nmode: 'en-srt'\n"), (2, "# role: x\nmode:\nrole: secondary"), (3, ""), (4, None), (5, "role : primary")]
    got = {r.video_id: (r.role, r.mode) for r in T.parse_manifests(spark.createDataFrame(files, "video_id long, file string")).collect()}
    assert got[1] == ("primary", "en-srt") and got[2] == ("secondary", None) and got[3] == got[4] == (None, None)
