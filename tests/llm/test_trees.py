"""Merkle manifest, lexical search and fingerprints against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuegrain.llm import fingerprints, lexical, manifest

from .edge import LONG, edge_docs, edge_rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, i):
    """Siblings left and right of node i on each level but the last."""
    for level in levels[:-1]:
        first = i // 3 * 3
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 3])
        i //= 3


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row, text)))


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of rows (doc_id, source, lang, n_chars, text)."""
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1], []).append((r[0], leaf_of(r[:4], r[4]), r))
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (own := sorted(leaves[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), levels_of([x[1] for x in own])) for s in order}
    top = levels_of([trees[s][1][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        own, levels = trees[s]
        for i, (doc_id, leaf, r) in enumerate(own):
            proof = [*path(levels, i), *path(top, n)]
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r[4] is not None
            at = leaf_of(r[:4], r[4].replace("\n", "")) if tampered else leaf
            for left, right in proof:
                at = sha(left + at + right)
            out.append((doc_id, leaf, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), at))
    return out


def test_manifest_by_brute_force(spark):
    """Sources of 1 to 700 rows (more than one stored level above the leaves), null and clashing fields, shared ids and equal rows."""
    rng = random.Random(11)
    rows = []
    for s, n in ((None, 5), ("", 1), ("a", 3), ("b", 82), ("é", 243), ("z", 700)):
        rows += [(rng.randrange(10**6), s, rng.choice(["en", None]), rng.choice([1, None]), rng.choice([f"line\nof {i}", None, "", "é\n"])) for i in range(n)]
    rows += [(None, "a", "en", 1, "x\ny"), (None, "a", "en", 1, "x\ny"), (7, "b", "en", 1, "p\n"), (7, "b", "en", 1, "q\n"), (7, "b", "en", 1, "q\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = manifest.report(df.selectExpr("*", "1 as tree", "2 as idx", "'x' as node"))
    made = [tuple(r)[:6] for r in got.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(made, key=key) == sorted(brute_manifest(rows), key=key)
    assert all(r.verified == (r.folded_root == r.root) for r in got.collect())


def test_manifest_of_few_rows(spark):
    one = spark.createDataFrame([(1, "a", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    r = manifest.report(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified
    assert manifest.report(one.limit(0)).count() == 0
    assert manifest.report(edge_docs(spark)).count() == len(edge_rows())


def test_manifest_finds_any_change(spark):
    """A proof holds for its own leaf only."""
    rows = [(i, "a", "en", 1, f"t{i}") for i in range(40)]
    proved = manifest.prove(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    both = proved.select("doc_id", "root", manifest.fold(F.col("leaf"), F.col("proof")).alias("own"), manifest.fold(F.sha2(F.col("doc_id").cast("string"), 256), F.col("proof")).alias("other"))
    assert all(r.own == r.root != r.other for r in both.collect())


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = str.maketrans(lexical.UPPER, lexical.LOWER)
    return [t.translate(lower) for t in TERM.findall(text or "")]


def brute_search(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, words = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for i, own in asked.items():
        scored = []
        for d, b in bags:
            m = 10 + 90 * b.total() * total // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in own if t in b)
            if score > 0:
                scored.append((-score, d is None, d))
        out |= {(i, n, d, -s) for n, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)}
    return out


@pytest.mark.parametrize("blocks", [(4096, 1 << 20), (7, 60)])
def test_search_by_brute_force(spark, blocks, monkeypatch):
    """Random bags, copies, ties, shared ids; trees of all rows and of a few; one pack and many."""
    rng = random.Random(12)
    word = lambda: rng.choice(["The", "the", "ÉTÉ", "été", "x1", "漢字", "a", "b", "c", "d", "e"]) + rng.choice(["", "", "s", "t"])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    docs = [(i, text(rng.randrange(0, 30))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(None, docs[5][1]), (None, None), (5, docs[5][1]), (7, text(9))]
    items = [(i, text(rng.randrange(0, 8))) for i in range(25)] + [(3, text(4)), (None, text(5)), (99, None), (98, "!?")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "BLOCK_DOCS", blocks[0])
    monkeypatch.setattr(lexical, "BLOCK_ENTRIES", blocks[1])
    want = brute_search(docs, items)
    assert {tuple(r) for r in lexical.search(d, q).collect()} == want
    assert {tuple(r) for r in lexical.search(d, q, pack_terms=30).collect()} == want


def test_search_edges(spark):
    docs, items = edge_docs(spark), spark.createDataFrame([(1, "the lazy dog word5 thing7"), (2, None)], "item_id long, text string")
    rows = [r[:2] for r in edge_rows()]
    assert {tuple(r) for r in lexical.search(docs, items).collect()} == brute_search(rows, [(1, "the lazy dog word5 thing7")])
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert lexical.search(d, q).columns == ["item_id", "rank", "doc_id", "score"] and lexical.search(d, q).count() == 0


def test_counts_of_a_text_cut_in_chunks(monkeypatch):
    monkeypatch.setattr(lexical, "_CHUNK", 7)
    rng = random.Random(13)
    for _ in range(200):
        t = "".join(rng.choice("aB é\n.") for _ in range(rng.randrange(60)))
        assert lexical.term_counts(t.encode()) == Counter(x.encode() for x in terms(t))


def test_a_trees_bounds_hold(spark):
    """No node's bound is below a score beneath it, and a leaf's bound is its score."""
    import numpy as np

    rng = random.Random(14)
    vecs = [sorted({rng.randrange(12) for _ in range(rng.randrange(1, 8))}) for _ in range(60)]
    t = [np.array(v, dtype=np.int32) for v in vecs]
    c = [np.array([rng.randrange(1, 5) for _ in v], dtype=np.int32) for v in vecs]
    m = [rng.randrange(10, 90) for _ in vecs]
    tree = lexical.Tree(t, c, m, list(range(60)))
    assert sorted(i for ids in tree.ids for i in ids) == list(range(60))
    weight = np.arange(1, 13)

    def below(node):
        return tree.ids[tree.leaf[node]] if tree.leaf[node] >= 0 else [i for x in tree.children[node] for i in below(x)]

    for node in range(len(tree.leaf)):
        bound = lexical.gains(weight[tree.terms[node]], tree.most[node], tree.m[node]).sum()
        scores = [lexical.gains(weight[t[i]], c[i].astype(np.int64), m[i]).sum() for i in below(node)]
        assert bound >= max(scores) and tree.first[node] == min(below(node))
        if tree.leaf[node] >= 0:
            assert bound == scores[0]


def report_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return fingerprints.report(df.selectExpr("*", "1 as key", "2 as times")).collect()


def test_edits_by_brute_force(spark):
    rng = random.Random(15)
    text = lambda: "".join(rng.choice("ab .!\né漢😀") for _ in range(rng.randrange(0, 400)))
    rows = [(i * 3, text()) for i in range(60)] + [(500, None), (501, ""), (502, "x"), (503, "abc")]
    texts = [t or "" for _, t in rows]
    got = {r.doc_id: r for r in report_of(spark, rows)}
    assert len(got) == len(rows)
    for i, (d, _) in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        q = len(t) // 4
        made = t[: len(t) - q] + nxt[:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(made))
        assert (r.fingerprint == r.edited_fingerprint) == (t == made)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1 or t != made)
        # the edit is never before the first difference by more than the piece that holds it
        if t != made:
            first = next((j for j, (a, b) in enumerate(zip(t, made)) if a != b), min(len(t), len(made)))
            assert r.edit_at <= first + 1 and (first - r.edit_at <= fingerprints.PIECE + 10)


def test_repeated_rows_follow_one_another(spark):
    same = [(1, "one. two. three. four."), (2, "five. six. seven. eight."), (2, "five. six. seven. eight."), (2, "five. six. seven. eight."), (None, "n" * 40), (None, "n" * 40), (3, "end of all.")]
    got = [(r.doc_id, r.edited_sha256, r.near_next) for r in report_of(spark, same)]
    order = sorted(same, key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(d, sha(t[: len(t) - len(t) // 4] + order[(i + 1) % 7][1][: len(t) // 4])) for i, (d, t) in enumerate(order)]
    assert sorted(g[:2] for g in got if g[0]) == sorted(w for w in want if w[0]) and len(got) == 7
    assert sorted(g[1] for g in got if g[0] is None) == sorted(w[1] for w in want if w[0] is None)
    assert sorted(g[2] for g in got if g[0] == 2)[1:] == [1.0, 1.0]


def test_a_key_on_most_rows(spark):
    """A row repeated a thousand times is one row of the joins."""
    rows = [(9, "hot row of some words here.")] * 3000 + [(i, f"text {i}.") for i in range(10, 40)]
    got = report_of(spark, rows)
    assert len(got) == 3030 and sum(r.doc_id == 9 and r.near_next == 1.0 for r in got) == 2999


def test_likeness_and_where_an_edit_begins(spark):
    base = "\n".join(f"Sentence {i} of the text. And one more {i * i}." for i in range(40))
    pairs = [(base, base), (base, base.replace("Sentence 20", "Phrase 20")), (base, base + "\nmore."), (base, ""), ("", ""), ("a.\n" * 50, "a.\n" * 40), (base, base[::-1]), ("x", "y")]
    a, b = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", a.alias("x"), b.alias("y"))
    x, y = F.col("x"), F.col("y")
    rows = df.select("a", "b", "x", "y", fingerprints.likeness(x, y).alias("near"), fingerprints.edit_start(x, y).alias("at"), fingerprints.differing(x, y).alias("d")).collect()
    near = [r.near for r in rows]
    assert near[0] == near[4] == 1.0 and near[3] == near[6] == near[7] == 0.0 and 0.97 < near[1] < 1 and 0.97 < near[2] < 1 and near[5] == pytest.approx(80 / 90)
    assert rows[0].at is None and rows[1].at == base.index("Sentence 20") and rows[2].at == len(base) + 1
    assert len(rows[1].d.pieces) == 1 and len(rows[1].d.paragraphs) == 1 and not rows[0].d.pieces
    assert rows[0].x == rows[0].y and all((r.a == r.b) == (r.x == r.y) for r in rows)


def test_fingerprint_edges(spark):
    got = fingerprints.report(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows()) and any(r.n_chars == len(LONG) for r in got)
    assert fingerprints.report(edge_docs(spark).limit(0)).count() == 0
    one = fingerprints.report(spark.createDataFrame([(1, "a b c d. e f g h.")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == sha("a b c d. e f " + "a b ")


def test_language_sample_of_rows_without_ids(spark):
    """Many rows without an id are in the sample or out of it each on its own."""
    from cuegrain.llm import langid

    rows = [(None, f"wort{i} und der die das nummer{i}" if i % 2 else f"word{i} and the of it number{i}", "de" if i % 2 else "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, matrix = langid.train(docs, most=100)
    assert names == ["de", "en"]
    assert langid.score(["der die das", "and the of"], names, matrix)[0] == ["de", "en"]


def test_earlier_probabilities_do_not_see_their_row(spark):
    """Labels at random on texts of one own word each, twice: a link that saw a row or its copy would know it, one that did not cannot."""
    import numpy as np

    from cuegrain.llm import toxicity

    rng = random.Random(16)
    coin = [rng.randrange(2) for _ in range(300)]
    rows = [(2 * i + j, f"word{i}x common text of all", coin[i], coin[i]) for i in range(300) for j in range(2)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    # so the second model gets nothing from the first one's probability
    assert abs(float(chain.models[1].v[0])) < 2.0 and np.isfinite(chain.models[1].w).all()


def test_forty_label_columns(spark):
    from cuegrain.llm import toxicity

    rng = random.Random(17)
    words = [a + b + "word" for a in "abcdefgh" for b in "klmno"]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, *[int(w in t.split()) for w in words]) for i, t in enumerate(texts)], "doc_id long, " + ", ".join(f"{w} int" for w in words))
    chain = toxicity.train(docs, labels, names=tuple(words))
    got = {r.doc_id: r for r in toxicity.predict(docs, chain).collect()}
    right = sum((got[i][f"p_{w}"] > 0.5) == (w in t.split()) for i, t in enumerate(texts) for w in (words[0], words[20], words[39]))
    assert right > 0.95 * 3 * len(texts)
