r"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions only.

A text is cut at each \n into paragraphs, a paragraph into pieces (a sentence, or PIECE characters
of one that is longer), and paragraphs are grouped into sections that end after a paragraph whose
digest begins with one of ENDS, so that an edit moves no section but its own. A digest is SHA-256:
of a piece's text, of the digests and lengths of a paragraph's pieces, of the digests of a section's
paragraphs, of the sections' digests: the root. Equal texts have equal fingerprints, and the 256-bit root tells others.

The fingerprint is a string: the root and the number of characters of all pieces, then `/` and 8 digits for each section, `:` and 8 digits for
each paragraph, `,` and 8 digits and the number of characters for each piece. It is all that
`likeness` and `differing` need: the tree is walked from the root, branches of equal digest are
left, and the pieces of the others locate the edit.

`report` gives each document the fingerprints of its text and of an edited one. Documents are
ordered by a range sort of (id, digest, length) alone; texts are shuffled once, by digest of id and
text, and both joins use that one exchange; what a document takes of the next travels as the cut
piece. A key on many rows (repeated rows) is one row of the joins, and where it holds a thousandth
of all rows it is aggregated before the shuffle.

Defined cases: a null text is an empty one, which has one paragraph without pieces; \r belongs to
its paragraph; ids are ordered null first, rows that share an id by digest, and equal rows follow one
another; a single document is its own next; two texts without pieces are alike at 1; a text's tree
lives in its row's memory, at a time in proportion to its length; columns beyond doc_id and text are
not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, staged

PIECE = 64
PIECES = rf"[^.!?]{{1,{PIECE}}}[.!?]* *|[.!?]+ *"
ENDS = ("0", "1", "2", "3")
SHORT, DIGEST = 8, 64


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, also where `body` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def joined(digests: Column) -> Column:
    return digest(F.array_join(digests, ""))


def short(d: Column) -> Column:
    return F.substring(d, 1, SHORT)


def fingerprint(text: Column) -> Column:
    def paragraph(p: Column) -> Column:
        nodes = F.transform(F.regexp_extract_all(p, F.lit(PIECES), F.lit(0)), lambda x: F.concat(digest(x), F.char_length(x).cast("string")))
        shown = lambda x: F.concat(F.lit(","), short(x), F.substr(x, F.lit(DIGEST + 1)))
        return let(nodes, lambda ns: F.struct(joined(ns).alias("d"), F.array_join(F.transform(ns, shown), "").alias("shown")))

    def sections(ps: Column) -> Column:
        last = F.size(ps) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | F.substring(F.get(ps, i)["d"], 1, 1).isin(*ENDS))

        def section(es: Column, e: Column, j: Column) -> Column:
            first = F.when(j == 0, 0).otherwise(F.get(es, j - 1) + 1)
            own = F.slice(ps, first + 1, e - first + 1)
            return let(own, lambda o: let(joined(F.transform(o, lambda p: p["d"])), lambda d: F.struct(d.alias("d"), F.concat(F.lit("/"), short(d), F.array_join(F.transform(o, lambda p: F.concat(F.lit(":"), short(p["d"]), p["shown"])), "")).alias("shown"))))

        return let(ends, lambda es: F.transform(es, lambda e, j: section(es, e, j)))

    n_chars = F.length(F.translate(F.coalesce(text, F.lit("")), "\n", "")).cast("string")
    whole = lambda ss: F.concat(joined(F.transform(ss, lambda s: s["d"])), n_chars, F.array_join(F.transform(ss, lambda s: s["shown"]), ""))
    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), paragraph), lambda ps: let(sections(ps), whole))


def root(print_: Column) -> Column:
    return F.substring(print_, 1, DIGEST)


def n_chars(print_: Column) -> Column:
    """The characters of all pieces."""
    return F.substr(F.substring_index(print_, "/", 1), F.lit(DIGEST + 1)).cast("long")


def pieces(print_: Column) -> Column:
    """The pieces of a fingerprint: short digest and number of characters, as one text each."""
    return F.regexp_extract_all(print_, F.lit(r",([0-9a-f]+)"), F.lit(1))


def _size(piece: Column) -> Column:
    return F.substr(piece, F.lit(SHORT + 1)).cast("long")


def likeness(a: Column, b: Column) -> Column:
    """Characters in pieces that both fingerprints have, as often as both have them, over the mean of all: 0 to 1."""

    weight = lambda ps: F.aggregate(ps, F.lit(0).cast("long"), lambda n, p: n + _size(p))

    def repeated(tagged: Column) -> Column:
        """By runs in the sorted pieces of both, each piece with its side at the end."""
        here = lambda i: F.get(tagged, i)
        piece = lambda x: F.substring(x, 1, F.length(x) - 1)
        starts = F.filter(F.sequence(F.lit(0), F.size(tagged) - 1), lambda i: (i == 0) | (here(i) != here(i - 1)))

        def common(st: Column) -> Column:
            def both(s: Column, j: Column) -> Column:
                second = F.get(st, j + 1)
                n = F.least(second - s, F.coalesce(F.get(st, j + 2), F.size(tagged)) - second)
                return F.when(second.isNotNull() & (piece(here(s)) == piece(here(second))), n * _size(piece(here(s)))).otherwise(F.lit(0).cast("long"))

            return F.aggregate(F.transform(st, both), F.lit(0).cast("long"), lambda x, y: x + y)

        return let(starts, common)

    def of_pieces(x: Column, y: Column) -> Column:
        tag = lambda side: lambda p: F.concat(p, F.lit(side))
        once = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))  # then no piece is shared twice
        merged = let(F.sort_array(F.concat(F.transform(x, tag("a")), F.transform(y, tag("b")))), repeated)
        both = F.when(~F.arrays_overlap(x, y), F.lit(0).cast("long")).when(once, weight(F.array_intersect(x, y))).otherwise(merged)
        return F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(2.0 * both / (n_chars(a) + n_chars(b)))

    pair = F.struct(pieces(a).alias("a"), pieces(b).alias("b"))
    return F.when(root(a) == root(b), 1.0).otherwise(let(pair, lambda p: of_pieces(p["a"], p["b"])))


def branches(print_: Column, sign: str) -> Column:
    """The branches of a fingerprint's part below `sign`, each with all that is below it."""
    parts = F.split(print_, sign)
    return F.slice(parts, 2, F.size(parts))


def differing(a: Column, b: Column) -> Column:
    """The branches of `a` that `b` lacks, each once: sections, of those the paragraphs, of those the pieces.

    A branch is told by its text, so what lies below an equal section or paragraph is not looked at.
    """

    def paragraphs(s: Column) -> Column:
        below = lambda side: F.flatten(F.transform(s[side], lambda x: branches(x, ":")))
        return let(F.struct(F.array_except(below("a"), below("b")).alias("a"), F.array_except(below("b"), below("a")).alias("b")), lambda p: leaves(s, p))

    def leaves(s: Column, p: Column) -> Column:
        below = lambda side: F.flatten(F.transform(p[side], lambda x: branches(x, ",")))
        return F.struct(s["a"].alias("sections"), p["a"].alias("paragraphs"), F.array_except(below("a"), below("b")).alias("pieces"))

    x, y = branches(a, "/"), branches(b, "/")
    return let(F.struct(F.array_except(x, y).alias("a"), F.array_except(y, x).alias("b")), paragraphs)


def edit_start(a: Column, b: Column) -> Column:
    """Where the first piece that differs begins in the text of `a`, in code points; null if the roots are equal.

    The walk goes down from the root by the first branch that differs, past the lengths of those before it.
    """
    length = lambda part: F.aggregate(pieces(part), F.lit(0).cast("long"), lambda n, p: n + _size(p))

    def down(x: Column, y: Column, signs: str, at: Column) -> Column:
        def here(o: Column) -> Column:
            n = F.size(o["a"])
            # an equal number of branches, or one more, differs somewhere unless the texts are equal
            differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.get(o["a"], i).eqNullSafe(F.get(o["b"], i)))
            return let(differ[0], lambda i: past(o, i))

        def past(o: Column, i: Column) -> Column:
            before = F.transform(F.slice(o["a"], 1, i), lambda part: length(F.concat(F.lit(","), part)) if signs == "," else length(part) + (F.size(F.split(part, ":")) - 1 if signs[0] == "/" else F.lit(1)))
            start = at + F.aggregate(before, F.lit(0).cast("long"), lambda n, m: n + m)
            return start if signs == "," else down(F.coalesce(F.get(o["a"], i), F.lit("")), F.coalesce(F.get(o["b"], i), F.lit("")), signs[1:], start)

        return let(F.struct(branches(x, signs[0]).alias("a"), branches(y, signs[0]).alias("b")), here)

    return F.when(root(a) != root(b), down(a, b, "/:,", F.lit(0).cast("long")))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)))
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", key.alias("key"))


def _runs(keyed: DataFrame) -> DataFrame:
    """For each run of equal rows: key, and of the run before it (before the first: the last) key, doc_id, n_chars and rows. Written."""
    runs = keyed.select("key", "doc_id", F.char_length("text").cast("long").alias("n_chars")).groupBy("key", "doc_id", "n_chars").agg(F.count("*").alias("rows"))
    placed = staged(numbered(runs.withColumn("tree", F.lit("")), ["doc_id", "key"], "fingerprint-order"), "fingerprint-runs")
    before = placed.select(F.expr("(idx + 1) % size").alias("idx"), F.col("key").alias("before"), "doc_id", "n_chars", "rows")
    return staged(placed.select("idx", "key").join(before, "idx").drop("idx"), "fingerprint-pairs")


def _one_each(keyed: DataFrame, runs: DataFrame, most: int = 1000) -> DataFrame:
    """text and key, one row for each key."""
    total = runs.agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
    rows = keyed.select("text", "key")
    if (total["most"] or 0) <= 1:
        return rows
    # at most `most` keys have so many rows each
    hot = F.broadcast(runs.where(F.col("rows") >= max(2.0, total["rows"] / most)).select(F.col("before").alias("key")))
    few = rows.join(hot, "key", "left_semi").groupBy("key").agg(F.max("text").alias("text")).select("text", "key")
    rest = rows.join(hot, "key", "left_anti")
    seen = F.lag("key").over(Window.partitionBy("key").orderBy("key"))
    return rest.withColumn("_seen", seen).where("_seen is null").drop("_seen").unionByName(few)


def edited(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, text, n_chars, edited text and the fingerprint of the next document."""
    keyed = _keyed(docs)
    runs = _runs(keyed)
    once = _one_each(keyed, runs)
    quarter = F.expr("n_chars div 4").cast("int")
    handed = once.join(runs, "key").select(F.col("before").alias("key"), "doc_id", "n_chars", "rows", F.left("text", quarter).alias("taken"), fingerprint(F.col("text")).alias("next_print"))
    met = once.join(handed, "key")
    # all rows of a run but its last are followed by their like
    last = F.struct(F.lit(1).cast("long").alias("times"), "taken", "next_print")
    own = F.struct((F.col("rows") - 1).alias("times"), F.left("text", quarter).alias("taken"), F.lit(None).cast("string").alias("next_print"))
    nexts = F.explode(F.when(F.col("rows") > 1, F.array(last, own)).otherwise(F.array(last)))
    each = met.select("doc_id", "text", "n_chars", nexts.alias("_n")).select("doc_id", "text", "n_chars", "_n.*")
    cut = F.concat(F.left("text", (F.col("n_chars") - quarter).cast("int")), "taken")
    return each.select("doc_id", "n_chars", "text", cut.alias("edited"), "next_print", "times")


def report(docs: DataFrame) -> DataFrame:
    rows = edited(docs).select("doc_id", "n_chars", digest(F.col("edited")).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print", "times")
    a, b = F.col("fingerprint"), F.col("edited_fingerprint")
    judged = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(a, b).alias("near_edited"),
        likeness(a, F.coalesce("next_print", "fingerprint")).alias("near_next"),
        edit_start(a, b).alias("edit_at"),
        F.size(differing(a, b)["pieces"]).cast("long").alias("n_changed"),
        "times",
    )
    return judged.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_", "times")


#: Walks the same trees with unnested rows: x texts, p paragraphs, s sections, f fingerprints, c pieces of branches that the other text lacks.
ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') t, md5(coalesce(doc_id::varchar, '-') || ':' || coalesce(text, '')) k from documents),
o as (select row_number() over (order by doc_id nulls first, k) rid, * from d),
n as (select o.*, (rid % (select count(*) from o)) + 1 nrid, length(t)::bigint n_chars from o),
e as (select n.*, left(n.t, n_chars - n_chars // 4) || left(m.t, n_chars // 4) ed from n join (select rid, t from n) m on m.rid = n.nrid),
x as (select rid, 0 kind, t from e union all select rid, 1, ed from e),
q as (select rid, kind, generate_subscripts(string_split(t, chr(10)), 1) i, unnest(string_split(t, chr(10))) p from x),
r as (select *, regexp_extract_all(p, '{PIECES}') ps from q),
p as (select rid, kind, i, p, ps, sha256(coalesce(array_to_string(list_transform(ps, lambda z: sha256(z) || length(z)), ''), '')) d,
    coalesce(array_to_string(list_transform(ps, lambda z: ',' || left(sha256(z), {SHORT}) || length(z)), ''), '') own from r),
g as (select *, left(d, {SHORT}) || own shown, coalesce(sum((left(d, 1) in {ENDS})::int) over (partition by rid, kind order by i rows between unbounded preceding and 1 preceding), 0) sec from p),
s as (select rid, kind, sec, sha256(string_agg(d, '' order by i)) d, left(sha256(string_agg(d, '' order by i)), {SHORT}) || string_agg(':' || shown, '' order by i) shown from g group by all),
f as (select rid, kind, sha256(string_agg(d, '' order by sec)) || any_value(length(replace(t, chr(10), ''))) || string_agg('/' || shown, '' order by sec) fp from s join x using (rid, kind) group by all),
u as (select rid, kind, i, generate_subscripts(ps, 1) j, unnest(ps) z from p),
h as (select rid, kind, left(sha256(z), {SHORT}) || length(z) tok, length(z) len, count(*) c from u group by all),
w as (select rid, kind, sum(c * len) w from h group by all),
ne as (select a.rid, sum(least(a.c, b.c) * a.len) c from h a join h b on a.rid = b.rid and a.tok = b.tok and a.kind = 0 and b.kind = 1 group by all),
nn as (select n.rid, sum(least(a.c, b.c) * a.len) c from n join h a on a.rid = n.rid and a.kind = 0 join h b on b.rid = n.nrid and b.kind = 0 and a.tok = b.tok group by all),
ds as (select rid, kind, sec, shown from s where not exists (select 1 from s z where z.rid = s.rid and z.kind <> s.kind and z.shown = s.shown)),
dp as (select distinct g.rid, g.kind, g.shown, g.own from g join ds using (rid, kind, sec)),
dq as (select rid, kind, own from dp where not exists (select 1 from dp z where z.rid = dp.rid and z.kind <> dp.kind and z.shown = dp.shown)),
dt as (select distinct rid, kind, unnest(string_split(substr(own, 2), ',')) tok from dq where own <> ''),
c as (select rid, count(*) n_changed from dt where kind = 0 and not exists (select 1 from dt z where z.rid = dt.rid and z.kind = 1 and z.tok = dt.tok) group by rid),
l as (select *, coalesce(sum(length(p) + 1) over (partition by rid, kind order by i rows between unbounded preceding and 1 preceding), 0) pos from p),
fd as (select a.rid, min(a.i) i from l a left join l b on a.rid = b.rid and a.i = b.i and b.kind = 1 where a.kind = 0 and (b.i is null or a.d <> b.d) group by a.rid),
fl as (select fd.rid, a.pos, a.ps pa, b.ps pb from fd join l a on a.rid = fd.rid and a.i = fd.i and a.kind = 0 left join l b on b.rid = fd.rid and b.i = fd.i and b.kind = 1),
ea as (select rid, pos + coalesce(list_sum(list_transform(list_filter(range(1, len(pa) + 1), lambda j: pa[1:j] = pb[1:j]), lambda j: length(pa[j]))), 0) edit_at from fl)
select e.doc_id, e.n_chars, sha256(ed) edited_sha256, a.fp fingerprint, b.fp edited_fingerprint,
    case when a.fp = b.fp then 1.0::double when coalesce(wa.w, 0) + coalesce(wb.w, 0) = 0 then 1.0::double else 2.0::double * coalesce(ne.c, 0) / (coalesce(wa.w, 0) + coalesce(wb.w, 0)) end near_edited,
    case when a.fp = m.fp then 1.0::double when coalesce(wa.w, 0) + coalesce(wm.w, 0) = 0 then 1.0::double else 2.0::double * coalesce(nn.c, 0) / (coalesce(wa.w, 0) + coalesce(wm.w, 0)) end near_next,
    case when a.fp <> b.fp then coalesce(edit_at, e.n_chars + 1)::bigint end edit_at, coalesce(n_changed, 0)::bigint n_changed
from e join f a on a.rid = e.rid and a.kind = 0 join f b on b.rid = e.rid and b.kind = 1 join f m on m.rid = e.nrid and m.kind = 0
left join w wa on wa.rid = e.rid and wa.kind = 0 left join w wb on wb.rid = e.rid and wb.kind = 1 left join w wm on wm.rid = e.nrid and wm.kind = 0
left join ne on ne.rid = e.rid left join nn on nn.rid = e.rid left join c on c.rid = e.rid left join ea on ea.rid = e.rid
"""
