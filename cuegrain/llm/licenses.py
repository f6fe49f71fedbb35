"""Licence scan: a trained paragraph classifier, confirmed by its templates; DataFrame and ML functions only.

Paragraphs are the lines of a text; a notice is a run of lines, so hard-wrapped ones are whole. A
multinomial logistic regression with an L1 penalty over word uni- and bigrams of the templates
gives each run a probability for each licence family and for `unknown`. It is fitted on a bounded
sample: the templates whole, cut and set into other text, against NEGATIVES paragraphs of the
corpus and up to HARD more that speak of licences and are no notice. Calibration uses a first model,
fitted without a fifth of the templates (whole templates, with all their variations) and of the
paragraphs: on that fifth a temperature is fitted to the log loss, and the least probability that
lets no more than MISSES of the unknown paragraphs pass becomes the cutoff, so the unknown class is
calibrated on notices and near misses that the model has not seen. The model in use is fitted on
all. A prediction is confirmed if the run holds at least CONTAINED of the n-grams of one of that
family's templates; titles and SPDX lines must be held whole. Of the runs around a line, each template takes the one with most of its n-grams, then
the shortest. A run yields to a tighter one inside it that holds as great a share, and one that
holds a template in part to an overlapping run of another family with more n-grams.

The vocabulary is that of the templates, so the tables joined to the runs have a size fixed in
this file and are broadcast. Runs are sought only around lines with one of the templates' rarest
words, of which every run that holds enough has one: an exact cut. What lies between a
run's first and last line has at most SPAN words, more than any template. A run's share of a
template is never above that of all lines in reach, so templates below the bound there are left out.

Defined cases: null and empty texts have no paragraphs; blank lines are none and lines without
words do not part a run; a very long line is one paragraph; a corpus without paragraphs for the
sample trains on the templates and fixed sentences alone; rows are told by id and text, so those
that share an id, or have none, stand each for themselves and equal ones get the same result; at a
tie the family first by name wins; an empty table gives an empty one.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged
from .quality import let

NEGATIVES, HARD, MISSES, CONTAINED = 2_000, 500, 0.001, 0.6
#: For each paragraph of other text, this many rows are searched for lines that speak of licences.
SEARCHED = 10
#: An n-gram is a feature if one of its words is in no more than this share of the other paragraphs, or in FEW.
COMMON, FEW = 0.01, 3
#: What lines that speak of licences hold.
SPEAKS = "(?i)licen[cs]e|copyright|public domain"
UNKNOWN = "unknown"

#: Notices by which works name their licence, by family.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache License 2.0.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Released under the GNU General Public License, version 2.",
    ],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
#: The same header in the three GNU families.
for _family, _what, _name in (("agpl", "program", "Affero "), ("gpl", "program", ""), ("lgpl", "library", "Lesser ")):
    TEMPLATES[_family] += [
        f"it under the terms of the GNU {_name}General Public License as published by the Free Software Foundation",
        f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the GNU {_name}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ][1 if _name else 0 :]
#: Titles and SPDX identifiers, which count only if they are held whole.
TITLES = {
    "agpl": ["GNU Affero General Public License"],
    "apache-2.0": ["Apache License Version 2.0", "Apache License 2.0"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License"],
    "gpl": ["GNU General Public License"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License"],
    "mit": ["MIT License"],
    "mpl-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License 2.0"],
    "unlicense": ["The Unlicense"],
}
SPDX = {
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache-2.0": ["Apache-2.0"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"],
    "cc0": ["CC0-1.0"],
    "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "isc": ["ISC"],
    "lgpl": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "mit": ["MIT"],
    "mpl-2.0": ["MPL-2.0"],
    "unlicense": ["Unlicense"],
}
WHOLE = {f: TITLES.get(f, []) + [f"SPDX-License-Identifier: {x}" for x in SPDX[f]] for f in TEMPLATES}
#: Words between a run's first and last line: half as many again as the longest template has.
SPAN = 3 * max(len(t.split()) for ts in TEMPLATES.values() for t in ts) // 2
#: Sentences in such notices' words that name no licence.
OTHERS = [
    "The driver must hold a valid license to use this car.",
    "The museum is free and open to the public on Sunday.",
    "All rights reserved.",
    "You may not use this file after the meeting.",
    "The new version was released under pressure in May.",
    "Permission was granted to the committee to publish the general terms.",
    "This work is in the library and the copy is for any person who asks.",
    "The software and its documentation files are on the second disk.",
]


def words(text: Column) -> Column:
    """Lower-case words without punctuation at their ends."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", "")), lambda w: w != "")


_PUNCTUATION = string.punctuation + "\t\n\x0b\f\r"
_LOOSE = str.maketrans(_PUNCTUATION, " " * len(_PUNCTUATION))


def loose_words(text: Column) -> Column:
    """Lower-case words cut at any punctuation: cheaper than words()."""
    return F.split(F.translate(F.lower(text), _PUNCTUATION, " " * len(_PUNCTUATION)), " ")


def grams(tokens: Column) -> Column:
    """Words and pairs of neighbours, each once. The words are made once, not again for each pair."""
    def both(t: Column) -> Column:
        pairs = F.transform(t, lambda w, i: F.concat_ws(" ", w, F.get(t, i + 1)))
        return F.array_distinct(F.concat(t, F.slice(pairs, 1, F.greatest(F.size(t) - 1, F.lit(0)))))

    return let(tokens, both)


def paragraphs(docs: DataFrame) -> DataFrame:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(lines).alias("para", "line"))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(f, i, t, i >= len(ts)) for f, ts in sorted(TEMPLATES.items()) for i, t in enumerate(ts + WHOLE[f])]
    return spark.createDataFrame(rows, "family string, template int, line string, whole boolean")


def sample(docs: DataFrame) -> DataFrame:
    """Training rows (label, line, held): templates in variations, and other paragraphs."""
    spark = docs.sparkSession
    rows = docs.count()
    some = lambda n: F.pmod(F.xxhash64("doc_id", F.lit("licence sample")), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, n / max(rows, 1)))
    lines = lambda n, of: paragraphs(docs.where(some(n))).where(of).select("line", F.xxhash64("doc_id", "para", F.lit("licences")).alias("h")).orderBy("h")
    speaks = F.col("line").rlike(SPEAKS)
    # a line of a wrapped notice is no example of other text: most of its n-grams are one template's; nor is one that holds a template
    found = known(spark)
    listed = F.array(*[F.struct(F.lit(needed(t)).alias("need"), F.array(*[F.lit(g) for g in t.grams]).alias("grams")) for t in found])
    vocabulary = F.array(*[F.lit(g) for g in sorted({g for t in found for g in t.grams})])

    def plain_text(own: Column) -> Column:
        in_both = lambda some, t: F.size(F.array_intersect(some, t["grams"]))
        notice = lambda some: F.exists(listed, lambda t: let(in_both(some, t), lambda n: (n >= CONTAINED * F.size(own)) | (n >= t["need"])))
        return (F.size(own) > 0) & ~let(F.array_intersect(own, vocabulary), notice)

    plain = lines(NEGATIVES, ~speaks).limit(NEGATIVES)
    hard = lines(NEGATIVES * SEARCHED, speaks).limit(4 * HARD)
    both = plain.withColumn("hard", F.lit(False)).unionByName(hard.withColumn("hard", F.lit(True))).where(let(grams(words(F.col("line"))), plain_text))
    place = F.row_number().over(Window.partitionBy("hard").orderBy("h"))  # no more than NEGATIVES + 4 * HARD rows
    negatives = staged(both.withColumn("_place", place).where(~F.col("hard") | (F.col("_place") <= HARD)).select("line", "h"), "licence-negatives")
    others = spark.createDataFrame([(x,) for x in OTHERS], "line string").withColumn("h", F.xxhash64("line"))
    unknown = negatives.unionByName(others)
    around = negatives.select(F.slice(F.split("line", " "), 1, 12).alias("around"), F.pmod("h", F.lit(97)).alias("k")).groupBy("k").agg(F.min("around").alias("around"))
    # each template alone and in five variations: words before it, after it, a word in nine left out
    varied = templates(spark).select("family", "line", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("v"))
    varied = varied.withColumn("k", F.pmod(F.xxhash64("line", "v"), F.lit(97))).join(F.broadcast(around), "k", "left")
    thinned = F.filter(F.split("line", " "), lambda w, i: (F.pmod(F.xxhash64(w, i, "v"), F.lit(9)) != 0) | (F.col("v") % 4 != 3))
    extra = F.array_join(F.coalesce("around", F.array().cast("array<string>")), " ")
    text = F.when(F.col("v") % 4 == 1, F.concat_ws(" ", extra, F.col("line"))).when(F.col("v") % 4 == 2, F.concat_ws(" ", "line", extra)).otherwise(F.array_join(thinned, " "))
    # all variations of a template are on one side of the split
    notices = varied.select(F.col("family").alias("label"), text.alias("line"), F.xxhash64("line").alias("h"))
    rows = notices.unionByName(unknown.select(F.lit(UNKNOWN).alias("label"), "line", "h"))
    return rows.select("label", "line", (F.pmod("h", F.lit(5)) == 0).alias("held"), grams(words(F.col("line"))).alias("grams"))


class Model:
    """Weights of the n-grams that have any, the biases, the temperature and the cutoff."""

    def __init__(self, labels: list[str], bias: list[float], weights: dict[str, list[float]], anchors: list[str]):
        self.labels, self.bias, self.weights, self.anchors = labels, bias, weights, anchors
        self.temperature, self.cutoff = 1.0, 0.5

    def table(self, spark: SparkSession) -> DataFrame:
        """gram and its weights."""
        return spark.createDataFrame(sorted(self.weights.items()), "gram string, w array<double>")

    def verdict(self, sums: list[Column]) -> Column:
        """The likeliest family and its calibrated probability, from the sums of weights."""
        z = F.array(*[(F.coalesce(s, F.lit(0.0)) + b) / self.temperature for s, b in zip(sums, self.bias, strict=True)])

        def choose(z: Column) -> Column:
            known = F.slice(z, 2, len(self.labels) - 1)
            total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(z)))
            names = F.array(*[F.lit(x) for x in self.labels[1:]])
            family = F.element_at(names, F.array_position(known, F.array_max(known)).cast("int"))
            return F.struct(family.alias("family"), (F.exp(F.array_max(known) - F.array_max(z)) / total).alias("p"))

        return F.transform(F.array(z), choose)[0]


def needed(template) -> int:
    """How many of a template's n-grams confirm it."""
    n = len(template.grams)
    return n if template.whole else next(k for k in range(n + 1) if k / n >= CONTAINED)


def known(spark: SparkSession) -> list:
    return templates(spark).select("family", "whole", grams(words(F.col("line"))).alias("grams")).collect()


def anchors(rows: DataFrame) -> list[str]:
    """Words of which every run has one that holds enough of a template.

    What holds `needed` of n n-grams has one of any n - needed + 1: here those whose rarest part is
    rarest in other text. loose_words() has each part of a word wherever words() has the word.
    """
    found = known(rows.sparkSession)
    parts = lambda g: g.translate(_LOOSE).split() or [g]
    listed = rows.sparkSession.createDataFrame([(p,) for p in sorted({p for t in found for g in t.grams for p in parts(g)})], "p string")
    plain = rows.where(F.col("label") == UNKNOWN).select(F.explode(F.array_distinct(loose_words(F.col("line")))).alias("p")).groupBy("p").count()
    rarity = {r["p"]: r["count"] for r in plain.join(F.broadcast(listed), "p").collect()}
    key = lambda p: (rarity.get(p, 0), -len(p), p)
    chosen = set()
    for t in found:
        rarest = sorted(min(parts(g), key=key) for g in t.grams)
        chosen.update(sorted(rarest, key=key)[: len(t.grams) - needed(t) + 1])
    return sorted(chosen)


def train(docs: DataFrame) -> Model:
    rows = staged(sample(docs), "licence-sample")
    plain = rows.where(F.col("label") == UNKNOWN).select(F.explode("grams").alias("g")).groupBy("g").count()
    listed = templates(docs.sparkSession).select(F.explode(words(F.col("line"))).alias("g")).distinct()
    rarity = {r["g"]: r["count"] for r in plain.join(F.broadcast(listed), "g").collect()}
    common = max(COMMON * rows.where(F.col("label") == UNKNOWN).count(), FEW)
    vocabulary = sorted(r.gram for r in templates(docs.sparkSession).select(F.explode(grams(words(F.col("line")))).alias("gram")).distinct().collect())
    vocabulary = [g for g in vocabulary if min(rarity.get(w, 0) for w in g.split(" ")) <= common]
    labels = [UNKNOWN, *sorted(TEMPLATES)]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0)
    counter.setBinary(True)
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("double") - 1.0
    ready = counter.transform(rows.withColumn("y", number)).coalesce(1)
    learner = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", elasticNetParam=1.0, regParam=5e-4, maxIter=80, standardization=False, aggregationDepth=2)
    fitted = learner.fit(ready)
    matrix = fitted.coefficientMatrix.toArray()
    bias = [0.0] * len(labels)
    bias[: len(fitted.interceptVector)] = [float(x) for x in fitted.interceptVector]
    used = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(vocabulary) if abs(matrix[:, i]).max() > 0}
    model = Model(labels, bias, used, anchors(rows))
    # calibration on the held-out rows: temperature by log loss, then the cutoff
    held = learner.fit(ready.where(~F.col("held"))).transform(ready.where("held")).select("label", "y", vector_to_array("rawPrediction").alias("z"))
    grid = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]

    def loss(t: float) -> Column:
        top = F.array_max("z")
        total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))
        return F.avg(F.log(total) - (F.element_at("z", F.col("y").cast("int") + 1) - top) / t)

    losses = held.agg(*[loss(t).alias(str(i)) for i, t in enumerate(grid)]).first()
    model.temperature = min(zip(losses, grid, strict=True), key=lambda x: x[0] if x[0] is not None else 9e9)[1]
    t = model.temperature
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))
    known = F.array_max(F.slice("z", 2, len(labels) - 1))
    passed = held.where(F.col("label") == UNKNOWN).select((F.exp((known - top) / t) / total).alias("p")).agg(F.percentile("p", F.lit(1 - MISSES))).first()[0]
    model.cutoff = min(0.9, max(0.5, passed or 0.0))
    return model


def _reach(tokens: Column) -> Column:
    """How many of the lines, nearest first, a run may take in: those before them have at most SPAN words."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    add = lambda a, x: F.when(a["words"] <= SPAN, F.struct((a["words"] + F.size(x)).alias("words"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(tokens, start, add, lambda a: a["n"])


def around(docs: DataFrame, model: Model) -> DataFrame:
    """Each line with an anchor and the lines in its reach: doc_id, first (their first line's number), at (its place), tokens."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    is_near = lambda x: F.exists(loose_words(x), lambda w: w.isin(*model.anchors))
    limit = SPAN + 1

    def reach(rows: Column) -> Column:
        places = F.filter(F.transform(rows, lambda r, i: F.when(r["near"], i)), lambda i: i.isNotNull())

        def one(i: Column) -> Column:
            before = F.reverse(F.slice(rows["tokens"], F.greatest(i - limit, F.lit(0)) + 1, F.least(i, F.lit(limit))))
            after = F.slice(rows["tokens"], i + 2, F.lit(limit))
            return let(_reach(before), lambda n: F.struct((i - n).alias("first"), n.alias("at"), F.slice(rows["tokens"], i - n + 1, n + 1 + _reach(after)).alias("tokens")))

        return F.transform(places, one)

    texts = docs.where(F.exists(lines, is_near))
    rows = F.filter(F.transform(lines, lambda x: F.struct(words(x).alias("tokens"), is_near(x).alias("near"))), lambda r: F.size(r["tokens"]) > 0)
    # the outer form, as Spark computes the array twice for the plain one, to filter by its size
    return texts.select("doc_id", F.explode_outer(let(rows, reach)).alias("_a")).where("_a is not null").select("doc_id", "_a.*")


def line_grams(tokens: Column) -> Column:
    """The n-grams of lines, each with the first and the last line it is on."""
    own = lambda t, i: F.transform(grams(t), lambda g: F.struct(g.alias("g"), i.alias("a"), i.alias("b")))
    across = lambda t, i: F.struct(F.concat_ws(" ", F.element_at(t, -1), F.get(F.get(tokens, i + 1), F.lit(0))).alias("g"), i.alias("a"), (i + 1).alias("b"))
    return F.flatten(F.transform(tokens, lambda t, i: F.when(i + 1 < F.size(tokens), F.concat(own(t, i), F.array(across(t, i)))).otherwise(own(t, i))))


def runs(docs: DataFrame, model: Model) -> DataFrame:
    """Runs of lines that hold enough of a template: doc_id, first, last, tokens, family, held (n-grams), contained."""
    spark = docs.sparkSession
    all_templates = known(spark)
    listed = F.array(*[F.struct(F.lit(t.family).alias("family"), F.lit(needed(t)).alias("need"), F.array(*[F.lit(g) for g in t.grams]).alias("grams")) for t in all_templates])
    near = around(docs, model).withColumn("all", line_grams(F.col("tokens")))
    vocabulary = F.array(*[F.lit(g) for g in sorted({g for t in all_templates for g in t.grams})])
    fit = let(F.array_intersect(F.col("all")["g"], vocabulary), lambda some: F.filter(listed, lambda t: F.size(F.array_intersect(t["grams"], some)) >= t["need"]))
    found = staged(near.withColumn("fit", fit), "licence-near").where(F.size("fit") > 0)
    one = found.select("doc_id", "first", "at", "tokens", F.transform("tokens", F.size).alias("sizes"), "all", F.explode("fit").alias("t"))
    hits = F.filter("all", lambda x: F.array_contains(F.col("t.grams"), x["g"]))
    one = one.select("doc_id", "first", "at", "tokens", "sizes", "t.family", "t.need", F.size("t.grams").alias("size"), hits.alias("hits"))
    inside = lambda i, k: F.aggregate(F.slice("sizes", i + 2, F.greatest(k - i - 1, F.lit(0))), F.lit(0), lambda a, x: a + x)
    held = lambda i, k: F.size(F.array_distinct(F.filter("hits", lambda x: (x["a"] >= i) & (x["b"] <= k))["g"]))
    place = lambda i, k: F.when(inside(i, k) <= SPAN, F.struct(held(i, k).alias("held"), (i - k).alias("short"), (-i).alias("i")))
    ends = F.sequence("at", F.size("tokens") - 1)
    best = F.array_max(F.flatten(F.transform(F.sequence(F.lit(0), F.col("at")), lambda i: F.transform(ends, lambda k: place(i, k)))))
    one = staged(one.withColumn("b", best).where(F.col("b.held") >= F.col("need")), "licence-runs")
    first, length = -F.col("b.i"), 1 - F.col("b.short")
    return one.select(
        "doc_id", (F.col("first") + first).alias("first"), (F.col("first") + first + length - 1).alias("last"),
        F.flatten(F.slice("tokens", first + 1, length)).alias("tokens"), "family", F.col("b.held").alias("held"), (F.col("b.held") / F.col("size")).alias("contained"),
    )


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Notices: doc_id, first, last (lines with words, from 0), family, probability, held, contained."""
    spark = docs.sparkSession
    found = runs(docs, model)
    by_run = ["doc_id", "first", "last"]
    texts = found.groupBy(*by_run).agg(F.max("tokens").alias("tokens"))
    weighed = texts.select(*by_run, F.explode(grams(F.col("tokens"))).alias("gram")).join(F.broadcast(model.table(spark)), "gram")
    sums = [F.sum(F.get("w", F.lit(i))).alias(f"_{i}") for i in range(len(model.labels))]
    judged = weighed.groupBy(*by_run).agg(*sums).select(*by_run, model.verdict([F.col(f"_{i}") for i in range(len(model.labels))]).alias("_r"))
    judged = judged.select(*by_run, F.col("_r.p").alias("probability"), F.col("_r.family").alias("family")).where(F.col("probability") > model.cutoff)
    shares = found.groupBy(*by_run, "family").agg(F.max("held").alias("held"), F.max("contained").alias("contained"))
    sure = staged(judged.join(shares, [*by_run, "family"]), "licence-sure")
    o = sure.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("first", "last", "family", "held", "contained")])
    tighter = (F.col("_first") >= F.col("first")) & (F.col("_last") <= F.col("last")) & (F.col("_last") - F.col("_first") < F.col("last") - F.col("first")) & (F.col("_contained") >= F.col("contained"))
    stronger = (F.col("_first") <= F.col("last")) & (F.col("_last") >= F.col("first")) & (F.col("_family") != F.col("family")) & (F.col("contained") < 1) & (F.col("_held") > F.col("held"))
    gone = sure.join(o, "doc_id").where(tighter | stronger).select(*by_run).distinct()
    return sure.join(gone, by_run, "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """Per document its paragraphs, its confirmed licence notices (overlapping runs are one), and their families."""
    row = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    ids = docs.select(F.col("doc_id").alias("id"), row.alias("doc_id"), "text")
    docs = ids.select("doc_id", "text")
    found = scan(docs, train(docs))
    above = F.max("last").over(Window.partitionBy("doc_id").orderBy("first", "last", "family").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", (F.col("first") > F.coalesce(above, F.lit(-1))).cast("long"))
    by_doc = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sum("new").alias("_n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("_p")
    )
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    own = ids.select("id", "doc_id", F.size(lines).cast("long").alias("n_paragraphs"))
    joined = own.join(by_doc, F.col("doc_id") == F.col("_id"), "left")
    return joined.select(F.col("id").alias("doc_id"), "n_paragraphs", F.coalesce("_n", F.lit(0)).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce(F.round("_p", 6), F.lit(0.0)).alias("probability"))
