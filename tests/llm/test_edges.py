"""Defined results of every operator on awkward tables and on an empty one."""

import hashlib
import re
import textwrap

import numpy as np
import pytest

from cuegrain.llm import bpe, langid, licenses, lines, mixing, quality, shingles, substrings, topk, toxicity
from cuegrain.llm.queries import vocabulary

from .edge import edge_docs, edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return edge_docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return edge_docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (9, 1, 0), (99, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_bpe_round_trip(docs):
    v = vocabulary()
    rows = bpe.encode(docs, v, decoded="back").select("text", "ids", "back", "kept").collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert bytes(r.back) == (r.text or "").encode() and r.kept == "x"
    again = bpe.decode(bpe.encode(docs, v).select("text", "ids"), v).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again)


def test_bpe_digest_of_nothing(docs):
    row = bpe.digests(docs, vocabulary()).where("doc_id = 4").first()
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_shingles_edges(docs):
    rows = shingles.join(docs).collect()
    assert len(rows) == len(edge_rows())
    by = {r.doc_id: r for r in rows}
    assert by[2].class_id == by[3].class_id == 1 and by[1].n_links == 2 and by[1].n_copies == 2
    assert by[4].class_id == 4 and by[5].n_links == 0 and by[6].class_id == 6
    assert by[None].class_id is None and by[None].n_links == 0
    assert by[7].n_links == 0 and by[9].n_links == 0 and by[10].n_copies == 2
    kept = shingles.dedup(docs).select("doc_id", "kept").collect()
    # the copy, the near copy and the repeated row go
    assert {2, 3} & {r.doc_id for r in kept} == set() and len(kept) == len(rows) - 3


def test_shingles_shared_ids(spark):
    """Rows that share an id, or have none, are documents each; the class is named by the least id there is."""
    text = lambda n: " ".join(f"{n}w{i}" for i in range(60))
    near = lambda n: text(n) + " more"
    rows = [(1, text("a")), (1, near("a")), (2, text("b")), (None, text("c")), (None, near("c")), (7, text("c")), (None, text("d")), (None, text("d")), (1, text("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in shingles.join(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1, 1), (1, 1, 1, 1), (2, 2, 1, 0), (None, 7, 2, 2), (None, 7, 1, 2), (7, 7, 2, 2), (None, None, 2, 1), (None, None, 2, 1), (1, 1, 1, 0)], key=repr)
    kept = sorted(((r.doc_id, r.text.split("w")[0]) for r in shingles.dedup(df).collect()), key=repr)
    assert kept == sorted([(1, "a"), (2, "b"), (7, "c"), (None, "d"), (1, "e")], key=repr)


def test_substrings_edges(docs):
    rows = substrings.dedup(docs).collect()
    assert len(rows) == len(edge_rows())
    by = {r.doc_id: r for r in rows}
    assert by[4].n_bytes == 0 and by[2].n_removed == by[2].n_bytes and by[2].n_spans == 1
    assert by[12].n_removed == 4999 and bytes(by[12].kept) == b"x"  # all but the first byte repeat
    assert by[3].n_removed > 250 and by[10].n_removed == 0


def test_mixing_edges(docs):
    rows = mixing.report(docs).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("doc_id = 9").count() in (1, 2)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.report(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in rows}


def test_quality_edges(docs, labels):
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in rows}
    assert by[4].n_words == 0 and by[4].base_failed and by[6].n_words == 0
    assert by[13].n_dup_lines == 49 and by[13].base_failed
    assert quality.keep(docs, labels).columns == docs.columns


def test_quality_keeps_each_row(spark, labels):
    """Rows without an id, or that share one, stand for themselves."""
    clean = " ".join(f"word{i}" for i in range(30))
    rows = [(None, clean), (None, "short"), (1, clean), (1, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, clean), (1, clean)]


def test_quality_risk_is_for_all_rules(spark):
    """6,000 different good texts: two rules would reject 9 (0.15 %) of them, one 120 (2 %). The two act, the third may not."""
    clean = lambda i: " ".join(f"word{i}x{j}" for j in range(12))
    dirty = (lambda i: clean(i).replace("word", "##########"), lambda i: clean(i).replace("word", "WORDWORDWORD"), lambda i: clean(i).replace("word", "!!!!!!!!!!"))
    good = [dirty[0 if i < 9 else 1 if i < 18 else 2](i) if i < 138 else clean(i) for i in range(6000)]
    bad = [dirty[i % 3](6000 + i) for i in range(3000)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 6000)) for i in range(9000)], "doc_id long, quality int")
    for kept in (quality.keep(docs, labels), quality.judge(docs, labels).where("kept")):
        left = {r.doc_id for r in kept.select("doc_id").collect()}
        assert len(left & set(range(6000))) == 6000 - 18  # the union stays within the 2 % of RISK
        assert len(left & set(range(6000, 9000))) == 1000
    # the same labels on copies of one text are one label: too few to reject by
    same = spark.createDataFrame([(i, clean(0) if i < 6000 else dirty[0](1), "en") for i in range(6100)], "doc_id long, text string, lang string")
    assert quality.judge(same, labels).where("kept").count() == 6100


def test_quality_measures_by_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.where("doc_id <> 10").collect()}
    for r in quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).where("doc_id is not null and doc_id <> 10").collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        seen, covered = {}, set()
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                for i in at:
                    covered.update(range(i, i + 5))
        ls = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id


def test_quality_words_end_at_ascii_space_only(spark):
    """U+0085, U+2028 and U+2029 are word characters, at the end of a text too."""
    rows = [(0, "a b c \u0085"), (1, "a b c \u2028"), (2, "a b c \u2029"), (3, "a b c \n"), (4, "a b c \u0085\n"), (5, "\u2028 a\r\n")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r.n_words for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang"), labels).collect()}
    assert got == {0: 4, 1: 4, 2: 4, 3: 3, 4: 4, 5: 2}


def test_exact_tail(spark):
    import math

    from pyspark.sql import functions as F

    for k, n in ((0, 10), (3, 200), (20, 5000), (200, 9000)):
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1))
        got = spark.range(1).select(quality.tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.02)).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def test_lines_edges(spark, docs):
    out = lines.documents(docs)
    assert out.columns == docs.columns and out.count() == len(edge_rows())
    rows = [(i, f"http://h.example/{i}", f"<p>common</p><p>own {i}</p><script>x</script>") for i in range(20)] + [(90, None, None), (91, "nonsense", "")]
    got = {r.page_id: r for r in lines.pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].kept_text == "own 3" and got[3].n_dropped == 1 and got[90].n_lines == 0 and got[91].kept_text == ""


def test_lines_of_small_and_nameless_hosts(spark):
    """A footer goes on a host of three pages; one page alone keeps its lines; no address and a bad one are two hosts."""
    page = lambda i: f"<p>own {i}</p><footer>all rights</footer>"
    rows = [(i, f"http://three/{i}", page(i)) for i in range(3)] + [(9, "http://alone/", page(9)), (10, None, page(10)), (11, "no address", page(11))]
    got = {r.page_id: (r.host, r.kept_text) for r in lines.pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [("three", f"own {i}") for i in range(3)]
    assert got[9] == ("alone", "own 9\nall rights") and got[10] == ("", "own 10\nall rights") and got[11] == ("", "own 11\nall rights")


def test_own_names_do_not_clash(spark):
    """Columns that bear an operator's inner names, or a dot, stay as they are."""
    odd = spark.createDataFrame([(1, "some plain words", "en", "s", "p", "q", "r", "t")], "doc_id long, text string, lang string, source string, _text string, _ids string, _row string, `a.b` string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    v = vocabulary()
    coded = bpe.encode(odd, v)
    for df in (coded, bpe.decode(coded, v), lines.documents(odd), mixing.mix(odd), langid.predict(odd, *langid.train(odd)), toxicity.predict(odd, toxicity.train(odd, labels))):
        r = df.first()
        assert r is None or (r["_text"], r["_ids"], r["_row"], r["a.b"]) == ("p", "q", "r", "t")
    kept = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)), "en", "x", "y")], "doc_id long, text string, lang string, `a.b` string, copy string")
    assert quality.keep(kept, labels).first()["a.b"] == "x"
    assert shingles.dedup(odd).columns == odd.columns and shingles.dedup(odd).first()["a.b"] == "t"


def test_langid_many_languages(spark):
    """Every language is learned, however many; a long text is scored in pieces."""
    rows = [(i, chr(0x4E00 + i) * 30, f"l{i:04d}") for i in range(700)]
    names, matrix = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(names) > 400 and matrix.shape == (langid.buckets_for(len(names)) + 1, len(names)) and matrix.size <= langid.MOST_CELLS + len(names)
    assert langid.buckets_for(4) == langid.BUCKETS
    got, _ = langid.score([chr(0x4E00 + int(names[7][1:])) * 300_000], names, matrix)
    assert got == [names[7]]


def test_langid_by_brute_force(spark):
    """The fitted matrix applied gram by gram; ties go to the first language."""
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat sat", "en"), ("le chat est la", "fr"), ("die katze", "de"), ("der Hund", "de"), ("a dog", "en")] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, matrix = langid.train(docs)
    for text in ("the dog", "la katze", "x", "Hund und Katze!"):
        points, _ = langid.code_points([text])
        total = matrix[-1].astype(float)
        for size in langid.SIZES:
            for j in range(len(points) - size + 1):
                g = points[j : j + size]
                if g[0] != 32 or g[-1] != 32:
                    b, _ = langid.buckets(g, size)
                    total = total + matrix[b[0]]
        lang, p = langid.score([text], names, matrix)
        assert lang[0] == names[int(total.argmax())] and p[0] == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-5)
    flat = np.zeros((3, 2), dtype=np.float32)
    assert langid.score(["abc"], ["aa", "bb"], flat)[0] == ["aa"]
    nothing = langid.train(docs.where("false"))
    assert langid.score(["abc"], *nothing)[0] == ["und"]


def test_langid_edges(docs):
    rows = langid.identify(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert by[4].lang_pred == "und" and by[14].lang_pred == "und" and by[4].score == 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_edges(docs, labels):
    rows = toxicity.scan(docs, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.p_toxic <= 1 for r in rows)


def test_licence_edges(spark, docs):
    more = spark.createDataFrame([(50, "Some text.\nReleased under the MIT License.\nMore.")], "doc_id long, text string")
    by = {r.doc_id: r for r in licenses.report(docs.select("doc_id", "text").unionByName(more)).collect()}
    assert by[50].families == "mit" and by[50].n_licensed == 1 and by[1].families == "" and by[4].n_paragraphs == 0


def test_licence_wrapped(spark):
    """Hard-wrapped notices, titles and SPDX lines; prose in their words is none."""
    bodies = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    }
    want, rows = {}, []
    for family, body in bodies.items():
        for width in (20, 45, 70):
            for mark in ("", " * ", "# "):
                text = "import os\n\n" + "\n".join(mark + x for x in textwrap.wrap(body, width)) + "\n\nx = 1\n"
                want[len(rows)] = (family, 1)
                rows.append((len(rows), text))
    for family, text in (("mit", "The MIT License\n\nmore"), ("mit", "MIT License"), ("mit", "// SPDX-License-Identifier: MIT"), ("gpl", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */")):
        want[len(rows)] = (family, 1)
        rows.append((len(rows), text))
    want[len(rows)] = ("bsd,mit", 2)
    rows.append((len(rows), "Released under the MIT License.\nReleased under the BSD 3-Clause License."))
    for text in ("He went to MIT.\nThe license of the driver was old.", "The permission of the museum\nis granted to the public\nfor any purpose.", "word\n" * 300):
        want[len(rows)] = ("", 0)
        rows.append((len(rows), text))
    got = {r.doc_id: (r.families, r.n_licensed) for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (100, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    assert by[(100, 1)] == (1, 1024 * 512 * 2) and by[(100, 2)] == (2, 1024 * 512 * 2)
    assert by[(100, 3)] == (2, 1024 * 512 * 2) and by[(100, 4)][0] == 0  # a repeated row is a candidate of its own
    assert len(got) == 8


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-600, 600, (700, 16))
    vectors[300:400] = vectors[300]  # many equal ones
    block = topk.Slices(np.arange(700), vectors.astype(np.int64))
    for q in (0, 5, 300, 350):
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:10]
        ids, found, _ = block.top(q, vectors[q].astype(np.int64), 10)
        assert ids.tolist() == order and found.tolist() == scores[order].tolist()


def test_empty_tables(spark, empty, labels):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        bpe.digests(empty, vocabulary()), shingles.join(empty), substrings.report(empty), mixing.report(empty), mixing.mix(empty), quality.judge(empty, labels), lines.documents(empty),
        lines.pages(pages), langid.identify(empty), toxicity.scan(empty, labels), licenses.report(empty), topk.nearest(vectors),
    ):
        assert df.count() == 0
