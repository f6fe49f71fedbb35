"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base measures are counted on each whole text. The method adds rules, each a measure in parts per
thousand with a grid of cutoffs; a document goes if any rule is over its cutoff. The labelled texts
that pass the base rule are split by a hash. On a quarter of them the pairs of rule and cutoff that
gain something (bad minus COST times good rejections) are put in order, those that reject fewest
good texts first: a sequence of ever stricter sets of cutoffs. On the rest, per stratum (language),
these sets are tested in that fixed order, each by the exact binomial bound on the share of good
texts that the whole set rejects: it must stay within RISK at confidence 1 - DELTA / strata, and the
first set that fails ends the sequence. A sequence fixed beforehand needs no share of DELTA for each
test, so it is divided by the strata alone, and since sets are tested whole, RISK bounds what a
stratum loses to all rules together. Of the sets that pass, the stratum takes the first of greatest
gain. About 220 good texts without a false rejection are enough to reject by, with four strata.
Copies of a text are one label, good if one of them is called so, since repeats are no independent
evidence.

Only labelled rows are measured before the thresholds are known; then each row is judged as it is
read, and no text is shuffled or written.

Defined cases: a null text has no words and, like an empty one, fails the base rule; a null
language is the stratum `und`; a null id has no label; labels for absent ids count nowhere, several
for one text as one; rows are judged each on their own; columns of any name stay in keep(); an
empty table gives an empty one. A text's windows live in its row's memory; equal windows are told
by 64-bit hashes, copies of a text by one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, col, staged

RISK, DELTA, COST = 0.02, 0.05, 10
WIDTH = 5
#: Parts per thousand from which a rule may reject.
CUTOFFS = (50, 100, 150, 200, 300, 400, 500, 600)
#: The first digits of a text's MD5 that put it in the quarter by which the sequence is ordered.
LEARN = ("0", "1", "2", "3")
#: Up to so many labels (ids and 0 or 1) are broadcast; more are joined by shuffle.
FEW_LABELS = 1_000_000
RULES = ("symbols", "duplicate_lines", "repeats", "capitals", "exclamations")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, also where `body` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of WIDTH that the text holds twice or more."""
    n = F.size(words)
    parts = lambda w, i: [F.get(w, i + j) for j in range(WIDTH)]
    hashes = F.when(n >= WIDTH, F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*parts(words, i)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda a, b: a["h"] == b["h"]
            at = lambda j: F.get(s, j)
            hit = F.filter(s, lambda x, j: F.coalesce(same(x, at(j - 1)), F.lit(False)) | F.coalesce(same(x, at(j + 1)), F.lit(False)))
            return let(F.sort_array(F.transform(hit, lambda x: x["i"])), steps)

        def steps(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(WIDTH), F.coalesce(F.get(p, j + 1) - x, F.lit(WIDTH))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return let(ordered, twice)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` without its text, with the base measures and the rules' measures.

    A filter that names `_once`, which is random, is not moved below the measures, where it would
    compute them again for each one that it tests.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    blanks = " \t\n\x0b\f\r"
    solid = F.translate(t, blanks, "")
    # \z and not $, which Java also finds before a last U+0085, U+2028 or U+2029: those are no white space here
    words = F.split(F.regexp_replace(t, rf"\A{SPACE}|{SPACE}\z", ""), SPACE)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, blanks, "")) > 0)
    spread = F.transform(F.array(F.struct(words.alias("w"), lines.alias("l"))), lambda s: F.struct(
        F.when(F.length(solid) > 0, F.size(s["w"])).otherwise(0).alias("n_words"),
        F.size(s["l"]).alias("n_lines"),
        (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).alias("n_dup_lines"),
        F.when(F.length(solid) > 0, _repeat_words(s["w"])).otherwise(0).alias("n_repeat_words"),
    ))[0]
    taken_out = lambda pattern: F.length(solid) - F.length(F.translate(solid, pattern, ""))
    rest = [c for c in df.columns if c != text]
    counted = df.select(
        *rest,
        spread.alias("_m"),
        F.length(solid).alias("word_chars"),
        taken_out("#*$%&|<>").alias("n_symbols"),
        taken_out("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        taken_out("!").alias("n_exclamations"),
        F.rand(0).alias("_once"),
    )
    names = ("word_chars", "n_symbols", "n_capitals", "n_exclamations")
    return counted.select(
        *rest,
        *[F.col(f"_m.{c}").cast("long").alias(c) for c in ("n_words", "n_lines", "n_dup_lines", "n_repeat_words")],
        *[F.col(c).cast("long").alias(c) for c in names],
        "_once",
    )


def per_thousand(rule: str) -> Column:
    part, whole = {
        "symbols": ("n_symbols", "word_chars"),
        "duplicate_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"),
        "capitals": ("n_capitals", "word_chars"),
        "exclamations": ("n_exclamations", "word_chars"),
    }[rule]
    return F.expr(f"coalesce(1000 * {part} div nullif({whole}, 0), 0)")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def tail(k: Column, n: Column, p: float) -> Column:
    """P[Bin(n, p) <= k], by the ratio of one term to the one before, in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda acc: acc["s"])


COUNTED = ("n_words", "n_lines", "n_dup_lines", "n_repeat_words", "word_chars", "n_symbols", "n_capitals", "n_exclamations")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled texts that pass the base rule, each once: copy, lang, measures, quality. Written."""
    one = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    one = F.broadcast(one) if labels.count() <= FEW_LABELS else one
    measured = measures(docs.select("doc_id", "lang", "text", F.md5(F.coalesce("text", F.lit(""))).alias("copy")).join(one, "doc_id"))
    # copies have all measures alike
    return staged(measured.where(~base_failed() & (F.col("_once") >= 0)).groupBy("copy", "lang", *COUNTED).agg(F.max("quality").alias("quality")), "quality-labelled")


def sequence(texts: DataFrame) -> list[tuple[str, int]]:
    """The pairs of rule and cutoff that gain on `texts`, those that reject fewest good texts first: at most the grid."""
    scores = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), per_thousand(r).alias("score")) for r in RULES]))
    counts = [F.count_if((F.col("quality") == q) & (F.col("_s.score") > c)).alias(f"{name}_{c}") for c in CUTOFFS for name, q in (("good", 1), ("bad", 0))]
    wide = texts.select("quality", scores.alias("_s")).groupBy("_s.rule").agg(*counts)
    steps = F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"good_{c}").alias("good"), F.col(f"bad_{c}").alias("bad")) for c in CUTOFFS]))
    gaining = wide.select("rule", steps.alias("_t")).select("rule", "_t.*").where(F.col("bad") > COST * F.col("good"))
    return [(r.rule, r.cutoff) for r in gaining.orderBy("good", F.desc("bad"), "rule", F.desc("cutoff")).collect()]


def thresholds(texts: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each stratum that rejects: its cutoff for each rule, null for rules that do not act.

    `texts` is as labelled() gives it. One row for each stratum and step remains after partial aggregation.
    """
    learn = F.substring("copy", 1, 1).isin(*LEARN)
    steps = sequence(texts.where(learn))
    if not steps:
        return texts.limit(0).select(F.col("lang").alias("stratum"), *[F.lit(None).cast("int").alias(r) for r in RULES])
    first = F.least(*[F.when(per_thousand(r) > c, i) for i, (r, c) in enumerate(steps)], F.lit(len(steps)))  # the step that would reject the text
    counts = texts.where(~learn).groupBy(F.coalesce("lang", F.lit("und")).alias("stratum"), first.alias("step")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    counts = staged(counts, "quality-steps")
    strata = counts.where("good > 0").select("stratum").distinct().count()
    up_to, all_ = Window.partitionBy("stratum").orderBy("step"), Window.partitionBy("stratum")
    tested = counts.select("stratum", "step", F.sum("good").over(all_).alias("n"), F.sum("good").over(up_to).alias("good"), F.sum("bad").over(up_to).alias("bad")).where(F.col("step") < len(steps))
    # rejections only grow along the sequence, so all sets before one that passes have passed
    passing = tested.where((F.col("n") > 0) & (F.col("good") <= risk * F.col("n"))).where(tail(F.col("good"), F.col("n"), risk) <= delta / max(1, strata))
    gain = (F.col("bad") - COST * F.col("good")).alias("gain")
    best = passing.groupBy("stratum").agg(F.max(F.struct(gain, (-F.col("step")).alias("back"))).alias("b")).where("b.gain > 0")

    def cutoff(rule: str) -> Column:
        own = [F.when(F.col("step") >= i, c) for i, (r, c) in enumerate(steps) if r == rule]
        return (F.least(*own) if len(own) > 1 else own[0] if own else F.lit(None)).cast("int").alias(rule)

    return best.select("stratum", (-F.col("b.back")).alias("step")).select("stratum", *map(cutoff, RULES))


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` (doc_id, lang, text, others) without its text, with measures, `base_failed` and `kept`."""
    chosen = staged(thresholds(labelled(docs, labels)).select("stratum", *[F.col(r).alias(f"_{r}") for r in RULES]), "quality-cutoffs")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(per_thousand(r) > F.col(f"_{r}"), F.lit(False))
    joined = measures(docs).join(chosen, F.coalesce("lang", F.lit("und")) == F.col("stratum"), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures, `base_failed` and `kept` of every row of `docs` (doc_id, text, lang)."""
    judged = _judged(docs.select("doc_id", "lang", "text"), labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, each judged on its own; the row goes with its measures."""
    rows = docs.select("doc_id", "lang", "text", F.struct(*map(col, docs.columns)).alias("_row"))
    return _judged(rows, labels).where("kept and _once >= 0").select("_row.*")


ORACLE = rf"""
with d as (select row_number() over () rid, doc_id, lang, coalesce(text, '') t from documents),
w as (select rid, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
win as (select rid, i, w[i:i + 4] g from (select rid, w, unnest(range(1, greatest(len(w) - 3, 1))) i from w)),
dup as (select rid, i from (select *, count(*) over (partition by rid, g) c from win) where c > 1),
cov as (select rid, count(distinct i + j)::bigint n from dup, (select unnest(range(0, 5)) j) group by rid),
m as (select w.rid, doc_id, lang, t, len(w)::bigint n_words, len(l)::bigint n_lines, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
    coalesce(cov.n, 0) n_repeat_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint n_capitals,
    (length(t) - length(regexp_replace(t, '!', '', 'g')))::bigint n_exclamations from w left join cov using (rid)),
b as (select *, dense_rank() over (order by t) text_no, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, coalesce(lang, 'und') stratum from m),
s as (select rid, doc_id, stratum, base_failed, text_no, unnest([
    {{'rule': 'symbols', 'score': coalesce(1000 * n_symbols // nullif(word_chars, 0), 0)}},
    {{'rule': 'duplicate_lines', 'score': coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0)}},
    {{'rule': 'repeats', 'score': coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)}},
    {{'rule': 'capitals', 'score': coalesce(1000 * n_capitals // nullif(word_chars, 0), 0)}},
    {{'rule': 'exclamations', 'score': coalesce(1000 * n_exclamations // nullif(word_chars, 0), 0)}}], recursive := true) from b),
c as (select unnest({list(CUTOFFS)}) cutoff),
lb as (select text_no, any_value(substr(md5(t), 1, 1) in {LEARN}) learn, stratum, max(quality) quality, any_value(rid) rid from b join labels using (doc_id)
    where not base_failed and quality is not null group by text_no, stratum),
g as (select rule, cutoff, count(*) filter (quality = 1 and score > cutoff) good, count(*) filter (quality = 0 and score > cutoff) bad
    from (select rid, quality from lb where learn) join s using (rid), c group by all),
sq as (select rule, cutoff, row_number() over (order by good, bad desc, rule, cutoff desc) - 1 step from g where bad > {COST} * good),
fs as (select lb.rid, lb.stratum, lb.quality, coalesce(min(step), 1000) step from lb left join (select rid, step from s join sq on s.rule = sq.rule and score > cutoff) f on f.rid = lb.rid where not learn group by all),
k as (select stratum, step, count(*) filter (quality = 1) good, count(*) filter (quality = 0) bad from fs group by all),
t as (select stratum, step, (sum(good) over (partition by stratum))::bigint n, (sum(good) over v)::bigint good, (sum(bad) over v)::bigint bad from k window v as (partition by stratum order by step)),
p as (select * from t where step < 1000 and n > 0 and good <= {RISK} * n and
    (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))
     from (select unnest(range(0, good + 1)) i)) <= {DELTA} / (select count(distinct stratum) from k where good > 0)),
o as (select stratum, max({{'gain': bad - {COST} * good, 'back': -step}}) m from p group by all),
x as (select distinct rid from s join o using (stratum) join sq on sq.rule = s.rule and sq.step <= -m.back and score > cutoff where m.gain > 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rid not in (select rid from x) kept from b
"""
