"""Keeping cues and transcripts in step: an edit of one is found and applied in the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import packed as P
from .edits import WIDTH, alike_blocks, let
from .sequences import best_pairing

BLANKS = r"[ \t\n\x0B\f\r]+"


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def placed(paragraphs: DataFrame, fragments: DataFrame, cues: DataFrame) -> DataFrame:
    """One row a video of `fragments`: them as `fragments`, with the `idx` and `offset` of locate_fragments, and its `cues` (idx, text) in order.

    Texts are shuffled once, to the row of their video.
    """
    def found(at_paragraph, paragraphs, numbers, cues, fragments):
        from bisect import bisect_right
        from itertools import accumulate, chain

        said = lambda texts: [(t or "").encode().split() for t in texts]
        count = lambda t: len(t.encode().split())
        solid = lambda c: c != "" and c not in " \t\n\x0b\f\r"
        nothing = [(None, None)] * len(fragments)
        if not at_paragraph or not numbers:
            return nothing
        ours, theirs = said(paragraphs), said(cues)
        if list(chain.from_iterable(ours)) != list(chain.from_iterable(theirs)):
            return nothing
        begin = dict(zip(at_paragraph, zip(paragraphs, map(len, ours), accumulate(map(len, ours), initial=0)), strict=True))
        full = [i for i, ws in enumerate(theirs) if ws]
        starts = list(accumulate((len(theirs[i]) for i in full), initial=0))

        def offset(text, words):
            """Where in a text with single blanks its word number `words` (from 0) begins; -1 is after the last."""
            parts = text.split(" ")
            return len(" ".join(parts[: words if words >= 0 else len(parts) + words + 1])) + min(words, 1)

        def place(f):
            if f["para_idx"] not in begin or f["at"] is None or f["old_part"] is None:
                return None, None
            (text, n, w0), lo = begin[f["para_idx"]], f["at"]
            hi = lo + len(f["old_part"])
            t0 = count(text[:lo]) - (lo > 0 and solid(text[lo - 1 : lo]) and solid(text[lo : lo + 1]))
            t1 = count(text[:hi]) - 1
            if t1 < t0:
                t0 = t0 if t0 < n else n - 1
            first, last = w0 + t0, w0 + max(t0, t1)
            k = bisect_right(starts, first) - 1
            if not 0 <= k < len(full) or last >= starts[k + 1]:
                return None, None
            return numbers[full[k]], offset(cues[full[k]], first - starts[k]) + lo - offset(text, t0)

        return [place(f) for f in fragments]

    part = lambda df, side, by: df.select("video_id", F.lit(side).alias("side"), F.col(by).cast("long").alias("idx"), "text")
    # a union of both, not a join: their texts go to the row once, and are sorted in it
    texts = P.in_rows(part(paragraphs, 0, "para_idx").unionByName(part(cues, 1, "idx")), "all", "side", "idx", "text")
    columns = [c for c in fragments.columns if c != "video_id"]
    rows = P.in_rows(fragments, "fragments", *columns).join(texts, "video_id", "left")
    of = lambda side, field: F.transform(F.filter("all", lambda x: x["side"] == side), lambda x: x[field])
    asked = F.transform("fragments", lambda x: F.struct(x["para_idx"].cast("long").alias("para_idx"), x["at"].cast("int").alias("at"), x["old_part"].alias("old_part")))
    made = F.udf(found, "array<struct<idx:bigint,offset:int>>", useArrow=True)(of(0, "idx"), of(0, "text"), of(1, "idx"), of(1, "text"), asked)
    kind = cues.schema["idx"].dataType

    def with_place(r: Column) -> Column:
        here = lambda i: F.get(r["places"], i)
        return F.transform(r["fragments"], lambda x, i: F.struct(*[x[c].alias(c) for c in columns], here(i)["idx"].cast(kind).alias("idx"), here(i)["offset"].alias("offset")))

    known = rows.select("video_id", "all", F.struct("fragments", made.alias("places")).alias("r"))
    ordered = F.transform(F.filter("all", lambda x: x["side"] == 1), lambda x: F.struct(x["idx"].cast(kind).alias("idx"), x["text"].alias("text")))
    return known.select("video_id", let(F.col("r"), with_place).alias("fragments"), ordered.alias("cues"))


def locate_fragments(paragraphs: DataFrame, fragments: DataFrame, cues: DataFrame) -> DataFrame:
    """The cue and the place in it of each fragment (video_id, para_idx, old_part, new_part, at) of a paragraph.

    Paragraphs and cues hold the same words in the same order, though cut differently; so a fragment's
    words are counted, and looked up in the cue that holds those numbers. `idx` and `offset` are null
    if the words of the video differ, or the fragment is on more than one cue.
    """
    return placed(paragraphs, fragments, cues).select("video_id", F.explode_outer("fragments").alias("x")).select("video_id", "x.*")


def holding(fragments: DataFrame, cues: DataFrame) -> DataFrame:
    """`fragments` (video_id, para_idx, old_part, ...) with each cue (idx, cue) of their video that may hold them.

    An inverted index of the cues' q-grams, three characters or as many as a shorter fragment has:
    each fragment is looked up by the rarest of its grams, so the cues that it meets are few, and
    one with a gram that no cue has meets none.
    """
    grams = lambda text, q: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substr(text, i, q)))
    q = F.least(F.length("old_part"), F.lit(3))
    asked = fragments.where("old_part <> ''").select("video_id", "para_idx", F.explode(grams(F.col("old_part"), q)).alias("g"))
    sizes = fragments.where("old_part <> ''").select("video_id", q.alias("q")).distinct()
    long_enough = cues.join(sizes, "video_id").where(F.length("cue") >= F.col("q"))
    postings = long_enough.select("video_id", "idx", F.explode(grams(F.col("cue"), F.col("q"))).alias("g")).join(asked.select("video_id", "g").distinct(), ["video_id", "g"])
    often = postings.groupBy("video_id", "g").agg(F.count("*").alias("n"))
    rarest = asked.join(often, ["video_id", "g"], "left").groupBy("video_id", "para_idx").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r"))
    met = rarest.where("r.n > 0").select("video_id", "para_idx", "r.g").join(postings, ["video_id", "g"]).select("video_id", "para_idx", "idx")
    return fragments.join(met, ["video_id", "para_idx"]).join(cues, ["video_id", "idx"])


def apply_edits(placed: DataFrame, width: int = WIDTH) -> DataFrame:
    """What each edit of `placed` rows makes of its cue: video_id, para_idx, result, idx, text, over_width.

    result is `located` (the fragment stands where it was counted to), `right cue` (elsewhere in that
    cue), `only one` (no place, but one cue of the video holds it), `not found`, `ambiguous`, or
    `nothing to find`. Fragments without a place are looked up by the rarest of their q-grams of three
    characters, or as many as they have, in an index of the video's cues that is made for such ones only.
    """
    def applied(edits, numbers, cues):
        numbers, cues = numbers or [], cues or []
        at, index = {i: t for i, t in zip(numbers, cues, strict=True)}, {}

        def holders(old):
            q = min(len(old), 3)
            if q not in index:
                index[q] = {}
                for n, text in enumerate(cues):
                    for g in {text[k : k + q] for k in range(len(text) - q + 1)} if text is not None else ():
                        index[q].setdefault(g, []).append(n)
            rarest = min((index[q].get(old[k : k + q], ()) for k in range(len(old) - q + 1)), key=len)
            return [n for n in rarest if old in cues[n]]

        def first(text, old, new):
            k = text.index(old)
            return text[:k] + new + text[k + len(old) :]

        def result(e):
            old, new, cue, place = e["old_part"], e["new_part"], at.get(e["idx"]), e["offset"]
            if old == "":
                return "nothing to find", e["idx"], None
            if cue is not None and place is not None and place >= 0 and cue[place : place + len(old)] == old:
                return "located", e["idx"], cue[:place] + new + cue[place + len(old) :]
            if cue is not None and old in cue:
                return "right cue", e["idx"], first(cue, old, new)
            hits = holders(old)
            if len(hits) == 1:
                return "only one", numbers[hits[0]], first(cues[hits[0]], old, new)
            return "ambiguous" if hits else "not found", None, None

        return [result(e) for e in edits]

    asked = F.transform("fragments", lambda x: F.struct(x["old_part"].alias("old_part"), x["new_part"].alias("new_part"), x["idx"].cast("long").alias("idx"), x["offset"].alias("offset")))
    of = lambda field: F.transform("cues", lambda x: x[field])
    made = F.udf(applied, "array<struct<result:string,idx:bigint,text:string>>", useArrow=True)(asked, F.transform(of("idx"), lambda i: i.cast("long")), of("text"))
    rows = placed.select("video_id", F.explode_outer(F.arrays_zip(F.transform("fragments", lambda x: x["para_idx"]).alias("para_idx"), made.alias("made"))).alias("x"))
    kind = placed.schema["cues"].dataType.elementType["idx"].dataType
    out = rows.select("video_id", "x.para_idx", "x.made.result", F.col("x.made.idx").cast(kind).alias("idx"), "x.made.text")
    return out.withColumn("over_width", F.coalesce(F.length("text") > width, F.lit(False)))


def versions(old: DataFrame, new: DataFrame, texts: DataFrame, order: str = "para_idx") -> DataFrame:
    """One row a video: its `old` and `new` cues (idx, text) in order and `said`, the words of its texts with single blanks; by one shuffle."""
    part = lambda df, side, by: df.select("video_id", F.lit(side).alias("side"), F.col(by).cast("long").alias("idx"), "text")
    rows = part(old, 0, "idx").unionByName(part(new, 1, "idx")).unionByName(part(texts, 2, order))
    packed = P.in_rows(rows, "all", "side", "idx", "text")
    of = lambda side: F.filter("all", lambda x: x["side"] == side)
    return packed.select("video_id", of(0).alias("old"), of(1).alias("new"), folded(F.array_join(F.transform(of(2), lambda x: x["text"]), " ")).alias("said"))


def regions(old: Column, new: Column) -> Column:
    """Of two arrays of texts `old` and `new`: for each changed text how many unchanged ones come before it, null for an unchanged one.

    Unchanged are equal texts, the k-th use of a text with the k-th: the longest run that rises in both versions.
    """
    def found(old, new):
        from bisect import bisect_left

        uses = {}
        for j in reversed(range(len(new))):
            uses.setdefault(new[j], []).append(j)
        uses.pop(None, None)
        pairs = [(i, uses[t].pop()) for i, t in enumerate(old) if uses.get(t)]
        tails, ends, links = [], [], []
        for k, (_, j) in enumerate(pairs):
            n = bisect_left(tails, j)
            tails[n : n + 1] = [j]
            ends[n : n + 1] = [k]
            links.append(ends[n - 1] if n else -1)
        kept, at = (set(), set()), ends[-1] if ends else -1
        while at >= 0:
            for side, place in zip(kept, pairs[at], strict=True):
                side.add(place)
            at = links[at]

        def number(size, kept):
            before = 0
            for i in range(size):
                yield None if i in kept else before
                before += i in kept

        return list(number(len(old), kept[0])), list(number(len(new), kept[1]))

    return F.udf(found, "struct<old:array<int>,new:array<int>>", useArrow=True)(old, new)


def stand(phrases: Column, said: Column) -> Column:
    """Whether each of an array of phrases stands in the text `said` by whole words; both with single blanks.

    A phrase is first looked for a little after the one before it. Else an index of the text's runs of
    up to three words, made once, gives the places of its rarest run, where its words are held
    against the text's. An empty phrase stands everywhere, null nowhere.
    """
    def found(phrases, said):
        size, reach = 3, 1000
        whole, at, index, out = f" {said or ''} ", 0, {}, []
        words = None

        def indexed(ws):
            n = min(len(ws), size)
            if n not in index:
                index[n] = {}
                for i in range(len(words) - n + 1):
                    index[n].setdefault(tuple(words[i : i + n]), []).append(i)
            places, i = min(((index[n].get(tuple(ws[i : i + n]), ()), i) for i in range(len(ws) - n + 1)), key=lambda x: (len(x[0]), x[1]))
            return any(at >= i and words[at - i : at - i + len(ws)] == ws for at in places)

        for p in phrases or ():
            if not p:
                out.append(p == "")
                continue
            next_ = whole.find(f" {p} ", at, at + len(p) + reach)
            if next_ >= 0:
                at = next_ + len(p) + 1
            else:
                words = whole.split() if words is None else words
            out.append(next_ >= 0 or indexed(p.split(" ")))
        return out

    return F.udf(found, "array<boolean>", useArrow=True)(phrases, said)


def standing(phrases: DataFrame, texts: DataFrame, order: str = "para_idx") -> DataFrame:
    """The distinct phrases (video_id, text) whose words stand in a row in the video's texts, read in `order`; see stand."""
    asked = phrases.distinct().select("video_id", F.lit(0).alias("idx"), "text")
    rows = versions(asked, asked.limit(0), texts, order)
    them = F.transform("old", lambda x: x["text"])
    found = rows.select("video_id", F.explode_outer(F.arrays_zip(them.alias("text"), stand(F.transform(them, folded), F.col("said")).alias("stands"))).alias("x"))
    return found.where("x.stands").select("video_id", "x.text")


def open_cues(rows: DataFrame) -> DataFrame:
    """Rows of `versions` as one row a video: `drifted`, how many unchanged cues are not in its texts in any case, and the changed `cues` (side, region, n, text, there), of which old ones have whether they are."""
    text, lower = (lambda c: F.transform(c, lambda x: x["text"])), (lambda c: F.transform(c, F.lower))
    known = rows.withColumn("r", regions(text("old"), text("new"))).withColumn("phrases", F.transform(text("old"), folded))
    known = known.withColumn("s", stand(F.col("phrases"), F.col("said"))).withColumn("d", stand(lower("phrases"), F.lower("said")))

    def changed(side: str, there) -> Column:
        made = F.transform(side, lambda x, i: F.struct(F.lit(side).alias("side"), F.get(F.col(f"r.{side}"), i).cast("long").alias("region"), (i + 1).alias("n"), x["text"].alias("text"), there(i).alias("there")))
        return F.filter(made, lambda x: x["region"].isNotNull())

    drifted = F.size(F.filter(F.transform("r.old", lambda r, i: r.isNull() & ~F.get("d", i)), lambda x: x))
    both = F.concat(changed("old", lambda i: F.get("s", i)), changed("new", lambda i: F.lit(None).cast("boolean")))
    return known.where("size(old) + size(new) > 0").select("video_id", drifted.alias("drifted"), both.alias("cues"))


def propagate(old: DataFrame, new: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Per video what an edit of its cues asks of the transcript: changed, removed, skipped (removed, but not in it), drifted (unchanged, but not in it), reblocked, inserted (which it cannot take).

    In a region with as many old cues as new each is paired with its counterpart. In others cues that
    are over half alike pair up, by the pairing of greatest likeness that keeps both orders; old cues
    that are left are removed, new ones inserted.
    """
    rows = staged(open_cues(versions(old, new, paragraphs)), "open-cues")
    open_ = rows.select("video_id", F.explode_outer("cues").alias("x")).where("x is not null").select("video_id", "x.*")
    is_old = F.col("side") == "old"
    joined = lambda side: folded(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("n", "text")))), lambda x: x["text"]), " "))
    sizes = open_.groupBy("video_id", "region").agg(F.count_if(is_old).alias("no"), F.count_if(~is_old).alias("nn"), joined("old").alias("x"), joined("new").alias("y"))
    kind = F.when(F.col("x") == F.col("y"), "reblocked").when(F.col("no") == F.col("nn"), "paired").when(F.col("nn") == 0, "deleted").when(F.col("no") == 0, "inserted").otherwise("mixed")
    sizes = staged(sizes.select("video_id", "region", "no", "nn", kind.alias("kind")), "regions")
    mixed = open_.join(sizes.where("kind = 'mixed'").select("video_id", "region"), ["video_id", "region"], "left_semi")
    keyed = mixed.select("video_id", "region", "side", F.col("n").alias("idx"), "text")
    cells = alike_blocks(keyed.where("side = 'old'"), keyed.where("side = 'new'"), keys=("video_id", "region"))
    alike = best_pairing(cells, ["video_id", "region"], "old", "new").select("video_id", "region", F.col("old").alias("n"), F.lit(True).alias("paired"))
    alike = staged(alike, "paired-cues")
    olds = open_.where(is_old).select("video_id", "region", "n", "there").join(sizes, ["video_id", "region"]).join(alike, ["video_id", "region", "n"], "left")
    gone = (F.col("kind") == "deleted") | ((F.col("kind") == "mixed") & F.col("paired").isNull())
    counts = olds.groupBy("video_id").agg(
        F.count_if((F.col("kind") == "paired") | F.col("paired").isNotNull()).alias("changed"), F.count_if(gone & F.col("there")).alias("removed"), F.count_if(gone & ~F.col("there")).alias("skipped"),
    )
    matched = alike.groupBy("video_id", "region").agg(F.count("*").alias("m"))
    extra = sizes.join(matched, ["video_id", "region"], "left").groupBy("video_id").agg(
        F.count_if(F.col("kind") == "reblocked").alias("reblocked"),
        F.sum(F.when(F.col("kind") == "inserted", F.col("nn")).when(F.col("kind") == "mixed", F.col("nn") - F.coalesce("m", F.lit(0))).otherwise(0)).alias("inserted"),
    )
    out = rows.select("video_id", "drifted").join(counts, "video_id", "left").join(extra, "video_id", "left")
    names = ("changed", "removed", "skipped", "drifted", "reblocked", "inserted")
    return out.select("video_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def review(changed: DataFrame, applied: DataFrame, propagated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per changed video which side was edited, how its edits were carried over, and whether it passes the checks."""
    good = F.col("result").isin("located", "right cue", "only one") & ~F.col("over_width")
    edits = applied.groupBy("video_id").agg(F.count_if(good).alias("applied"), F.count_if(~good).alias("refused"))
    j = changed.join(edits, "video_id", "left").join(propagated, "video_id", "left").join(verdicts.select("video_id", "passed"), "video_id", "left")
    state = F.when(F.coalesce(F.col("refused"), F.lit(0)) + F.coalesce(F.col("inserted"), F.lit(0)) > 0, "rebuild").when(F.coalesce("passed", F.lit(False)), "ready").otherwise("review")
    number = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return j.select("video_id", "cues_edited", "transcript_edited", *[number(n) for n in ("applied", "refused", "changed", "removed", "inserted")], state.alias("state"))
