"""Toxicity by a classifier chain of linear models over hashed words.

The categories are label columns, predicted in the chain's order; each model also takes the
probabilities of the categories before it. In training those are out-of-fold: each fold's come
from models fitted on the other folds, so later models see earlier ones as they will be, not as
they fit. The labels table has two categories, CHAIN; any other columns can be given.

Features are whole words and word beginnings, as 64-bit hashes, present or not. Training reads a
bounded sample: at most MOST_TRAIN labelled rows, those with the least hashes of id and text. Spark
counts the sample's features; for each category the FEATURES that tell it best are kept for its
model, so the chain has a fixed size and is broadcast, and the driver gets at most MOST_TRAIN rows
of FEATURES small numbers a category. Every row is scored, on its whole text.

Defined cases: a null or empty text has no features and gets the base rates; rows without a label
are scored alike; a null id is not trained on, nor a null label for its category; several labels
of one id count as the greatest; rows that share an id are trained on each, equal ones once; a
category whose sample lacks one of its labels has probability 0 everywhere; repeated rows are
scored alike; columns of any name stay but the text and the outputs; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, mapped, pieces, ship, staged, without
from .hashing import Rolling, mix
from .langid import code_points

CHAIN = ("quality", "toxic")
BEGINNINGS = (5, 7)
MOST_TRAIN, FEATURES, FOLDS = 6_000, 2_048, 3
#: A feature is on this many rows of the sample or more.
SUPPORT = 3
CUTOFF = 0.5


def word_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its beginnings, with the number of the text each is in."""
    points, edges = code_points(texts)
    inside = points != 32
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    rolling = Rolling(points)
    row = np.searchsorted(edges, starts, side="right") - 1
    found, rows = [rolling.ranges(starts, ends)], [row]
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > size)
        found.append(mix(rolling.ranges(starts[longer], starts[longer] + size) + np.uint64(size)))
        rows.append(row[longer])
    return np.concatenate(found), np.concatenate(rows)


class Linear:
    """L2-regularised logistic regression on rows of present features, by accelerated gradient steps."""

    def __init__(self, rows, cols, n, width, extra, y, weight=1e-3, steps=150):
        self.w, self.v, self.b = np.zeros(width), np.zeros(extra.shape[1]), 0.0
        m = max(n, 1)
        rate = np.bincount(cols, minlength=width) + 1.0
        pos = max(1.0, y.sum())
        self.b = float(np.log(pos / max(1.0, m - pos)))
        memory = [np.full(width, 1e-8), np.full(extra.shape[1], 1e-8), 1e-8]
        for _ in range(steps):
            p = self.probability(rows, cols, n, extra)
            e = p - y
            gw = np.bincount(cols, e[rows], minlength=width) + weight * rate * self.w
            gv = extra.T @ e + weight * m * self.v
            gb = e.sum()
            memory[0] += gw**2
            memory[1] += gv**2
            memory[2] += gb**2
            self.w -= 0.5 * gw / np.sqrt(memory[0])
            self.v -= 0.5 * gv / np.sqrt(memory[1])
            self.b -= 0.5 * gb / np.sqrt(memory[2])

    def probability(self, rows, cols, n, extra):
        z = self.b + np.bincount(rows, self.w[cols], minlength=n) + extra @ self.v
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Chain:
    """The kept hashes in order, and for each category its name and its linear model (None without both labels)."""

    def __init__(self, names: tuple[str, ...], kept: np.ndarray, models: list[Linear | None]):
        self.names, self.kept, self.models = names, kept, models
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(kept & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def columns(self, found: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the kept features, each pair once."""
        near = self.maybe[(found & np.uint64((1 << 20) - 1)).astype(np.int64)]
        found, rows = found[near], rows[near]
        if not len(self.kept) or not len(found):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.kept, found), len(self.kept) - 1)
        real = self.kept[at] == found
        pairs = np.unique(rows[real] * len(self.kept) + at[real])
        return pairs // len(self.kept), pairs % len(self.kept)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows, cols = self.columns(*word_features(texts))
        out = np.zeros((len(texts), len(self.models)))
        for c, model in enumerate(self.models):
            if model is not None:
                out[:, c] = model.probability(rows, cols, len(texts), out[:, :c])
        return out


def fit(names: tuple[str, ...], kept: np.ndarray, own: list[list[np.ndarray]], fold: np.ndarray, all_rows: np.ndarray, all_cols: np.ndarray, labels: np.ndarray) -> Chain:
    """A chain from the pairs (row, kept feature), the rows' folds, and the labels (rows x categories, NaN where unknown).

    `own` has for each category the features chosen on all rows, then those chosen without each fold: a
    row's earlier probability comes from a model that saw it, and its copies, neither in its features
    nor in its weights. Copies of a text are in one fold.
    """
    n = len(labels)
    earlier = np.zeros((n, 0))
    models: list[Linear | None] = []
    for y, used in zip(labels.T, own, strict=True):
        known = ~np.isnan(y)
        unseen = np.zeros(n)

        def model(chosen: np.ndarray, mask: np.ndarray, y=y, earlier=earlier) -> tuple[Linear, np.ndarray, np.ndarray]:
            rows, cols = all_rows[mask[all_cols]], all_cols[mask[all_cols]]
            return Linear(*_subset(rows, cols, chosen, n), len(chosen), len(kept), earlier[chosen], y[chosen]), rows, cols

        if not 0 < y[known].sum() < known.sum():
            models.append(None)
        else:
            models.append(model(np.flatnonzero(known), used[0])[0])
            for k, mask in enumerate(used[1:]):
                outs = np.flatnonzero(fold == k)
                linear, rows, cols = model(np.flatnonzero(known & (fold != k)), mask)
                unseen[outs] = linear.probability(*_subset(rows, cols, outs, n), len(outs), earlier[outs])
        earlier = np.column_stack([earlier, unseen])
    return Chain(names, kept, models)


def _subset(rows: np.ndarray, cols: np.ndarray, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.full(n, -1)
    new[chosen] = np.arange(len(chosen))
    inside = new[rows] >= 0
    return new[rows[inside]], cols[inside]


def sample(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], most: int) -> DataFrame:
    """At most `most` labelled rows: doc_id, mark, the categories and the text's features."""
    marked = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    given = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(col(c)).cast("double").alias(f"label{i}") for i, c in enumerate(names)])
    given = given.where(F.coalesce(*[f"label{i}" for i in range(len(names))]).isNotNull())
    rows = marked.select("doc_id", "mark").join(given, "doc_id").distinct()
    chosen = rows.orderBy(F.xxhash64("doc_id", "mark", F.lit("toxicity")), "doc_id", "mark").limit(most)
    full = marked.join(F.broadcast(staged(chosen, "toxicity-rows")), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    given_names = [f"label{i}" for i in range(len(names))]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for a, b in pieces(batch.column(last)):
                found, at = word_features(batch.column(last).slice(a, b - a).to_pylist())
                own = pa.array([np.unique(found[at == i]).view(np.int64) for i in range(b - a)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(last)], own], names=["doc_id", "mark", *given_names, "features"])

    source = full.select(F.col("doc_id").cast("long").alias("doc_id"), "mark", *given_names, "text")
    return source.mapInArrow(extract, ", ".join(["doc_id long", "mark long", *[f"{c} double" for c in given_names], "features array<bigint>"]))


def informative(rows: DataFrame, category: int, folds: bool) -> list[np.ndarray]:
    """The FEATURES hashes that tell a category best by chi-square: on all rows, then, if `folds`, on all but those of each fold."""
    y, fold = F.col(f"label{category}"), F.pmod("mark", F.lit(FOLDS))
    parts = range(FOLDS) if folds else ()
    known = rows.where(y.isNotNull()).select(y.alias("y"), fold.alias("fold"), "features")
    in_fold = lambda k: F.sum(F.when(F.col("fold") == k, F.col("y")).otherwise(0.0)).alias(f"p{k}")
    tallies = [F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("p"), *[x for k in parts for x in (F.count_if(F.col("fold") == k).alias(f"n{k}"), in_fold(k))]]
    totals = known.agg(*tallies).first()
    counts = known.select("y", "fold", F.explode("features").alias("feature")).groupBy("feature").agg(*tallies)
    counts = staged(counts.where(F.col("n") >= SUPPORT), "toxicity-counts")
    found = []
    for k in (None, *parts):
        n, p = (F.col("n"), F.col("p")) if k is None else (F.col("n") - F.col(f"n{k}"), F.col("p") - F.col(f"p{k}"))
        size, positive = (totals.n, totals.p) if k is None else (totals.n - totals[f"n{k}"], totals.p - (totals[f"p{k}"] or 0.0))
        share = positive / max(size, 1)
        chi = (p - n * share) ** 2 / (n * share * (1 - share) + 1e-9)
        chosen = counts.where(n >= SUPPORT).orderBy(chi.desc(), "feature").limit(FEATURES).select("feature").collect()
        found.append(np.sort(np.array([r[0] for r in chosen], dtype=np.int64).view(np.uint64)))
    return found


def train(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = CHAIN, most: int = MOST_TRAIN) -> Chain:
    ship(docs.sparkSession)
    rows = staged(sample(docs.select("doc_id", "text"), labels, names, most), "toxicity-sample")
    # the last category's probabilities feed no other, so it needs no folds
    told = [informative(rows, i, i + 1 < len(names)) for i in range(len(names))]
    kept = np.unique(np.concatenate([t for own in told for t in own]))
    given_names = [f"label{i}" for i in range(len(names))]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            own = [np.flatnonzero(np.isin(kept, x.values.to_numpy().view(np.uint64))).astype(np.int32).tobytes() for x in batch.column(last)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(last)], pa.array(own, pa.binary())], names=["doc_id", "mark", *given_names, "features"])

    schema = ", ".join(["doc_id long", "mark long", *[f"{c} double" for c in given_names], "features binary"])
    found = rows.mapInArrow(narrow, schema).toArrow().sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    columns = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in found["features"].to_pylist()]
    y = np.column_stack([np.array([np.nan if v is None else v for v in found[c].to_pylist()], dtype=float) for c in given_names])
    at = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    fold = np.array(found["mark"].to_pylist(), dtype=np.int64) % FOLDS
    return fit(names, kept, [[np.isin(kept, t) for t in own] for own in told], fold, at, np.concatenate(columns) if columns else np.empty(0, dtype=np.int64), y)


def predict(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """`df` without its text, with p_<category> for each category and `toxic`, the verdict on the last one."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(chain)
    added = [f"p_{c}" for c in chain.names]
    rest = without(df, text, "toxic", *added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1)
            for a, b in pieces(texts):
                p = model.scores(texts.slice(a, b - a).to_pylist())
                made = [pa.array(np.round(p[:, c], 6)) for c in range(len(added))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made, pa.array(p[:, -1] >= CUTOFF)], names=["_row", *added, "toxic"])

    return mapped(df, rest, col(text), run, [*[(name, T.DoubleType()) for name in added], ("toxic", T.BooleanType())])


def scan(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return predict(docs, train(docs, labels))
