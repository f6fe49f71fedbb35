"""Language identification: multinomial naive Bayes over hashed character n-grams.

Each task counts its training texts' n-grams by language and bucket; Spark adds the counts; the
matrix of log-probabilities (buckets x languages) is broadcast. It has at most MOST_CELLS cells:
up to 512 languages have BUCKETS rows, beyond that each doubling of the languages halves the
buckets, and no language is left out. Texts are scored in numpy, a batch at a time: each n-gram
picks a row of the matrix, and rows are summed by text, PIECE n-grams at a time.

Training reads a bounded sample: at most about MOST_TRAIN rows, chosen by a hash of their id from
all rows that may be learned from. Every row is scored, on its whole text.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text if
nothing could be learned; a null language is not learned from; a null id is never held out; ties
go to the language first by code point; repeated rows are scored alike; other columns stay; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, mapped, pieces, ship, without
from .hashing import mix

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
SMOOTHING = 0.1
MOST_TRAIN, MOST_CELLS, PIECE = 20_000, 1 << 25, 1 << 18

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, 32 for what is no letter and 32 after each text; where texts begin."""
    parts = [(t or "").lower() + " " for t in texts]
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(letters()[points], points, np.uint32(32)), edges


def buckets(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram that has a letter first or last, and the position of its last character."""
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    key = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        key = key * np.uint64(0x110003) + points[j : n + j]
    at = np.flatnonzero((points[:n] != 32) | (points[size - 1 :] != 32)) if size > 1 else np.flatnonzero(points != 32)
    return (mix(key[at]) & np.uint64(BUCKETS - 1)).astype(np.int64), at + size - 1


def buckets_for(langs: int) -> int:
    """The most buckets, a power of two up to BUCKETS, whose matrix has no more than MOST_CELLS cells."""
    size = BUCKETS
    while size > 1 and size * langs > MOST_CELLS:
        size //= 2
    return size


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, most: int = MOST_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log-probabilities, its last row the priors, from rows that are not held out."""
    ship(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    total = usable.select("doc_id").count()
    # by id and text: many rows may share an id or have none
    keep = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("langid")), F.lit(1_000_003)) < int(1_000_003 * min(1.0, most / max(total, 1))) + 1
    source = usable.where(keep).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                points, edges = code_points(batch.column(1).slice(a, b - a).to_pylist())
                langs = batch.column(0).slice(a, b - a).to_pylist()
                names = sorted(set(langs))
                of_row = np.array([names.index(x) for x in langs])
                of_char = np.repeat(of_row, np.diff(edges))
                for size in SIZES:
                    found, at = buckets(points, size)
                    added = np.bincount(of_char[at] * (BUCKETS + 1) + found, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                    for i, name in enumerate(names):
                        sums[name] = sums.get(name, 0) + added[i]
                for i, name in enumerate(names):
                    sums[name][BUCKETS] += int((of_row == i).sum())
        for name, c in sums.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(c[used].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = source.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    names, lang = np.unique(np.array(found["lang"].to_pylist(), dtype=object), return_inverse=True) if found.num_rows else (np.array([]), np.array([], dtype=int))
    size = buckets_for(len(names))
    bucket, n = (found[c].to_numpy() for c in ("bucket", "n"))
    rows = bucket == BUCKETS
    documents = np.bincount(lang[rows], n[rows], minlength=len(names))
    table = np.zeros((size, len(names)))
    np.add.at(table, (bucket[~rows] & (size - 1), lang[~rows]), n[~rows])
    prior = np.log(documents / max(1.0, documents.sum()))
    grams = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * size))
    return names.tolist(), np.vstack([grams, prior[None, :]]).astype(np.float32)


def score(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    points, edges = code_points(texts)
    total = np.zeros((len(texts), len(names)))
    seen = np.zeros(len(texts), dtype=np.int64)
    for size in SIZES:
        found, at = buckets(points, size)
        found &= len(matrix) - 2
        seen += np.diff(np.searchsorted(at, edges))
        for i in range(0, len(found), PIECE):
            cuts = np.searchsorted(at[i : i + PIECE], edges)
            full = np.flatnonzero(np.diff(cuts))
            total[full] += np.add.reduceat(matrix[found[i : i + PIECE]], cuts[full], axis=0, dtype=np.float64)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    total += matrix[-1]
    best = total.argmax(axis=1)
    share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [names[b] if n else "und" for b, n in zip(best, seen, strict=True)], np.where(seen > 0, share, 0.0)


def predict(df: DataFrame, names: list[str], matrix: np.ndarray, text: str = "text") -> DataFrame:
    """`df` without its text, with lang_pred and score, which take the place of columns of that name."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((names, matrix))
    rest = without(df, text, "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in pieces(texts):
                langs, scores = score(texts.slice(a, b - a).to_pylist(), *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, type=pa.string()), pa.array(scores)], names=["_row", "lang_pred", "score"])

    return mapped(df, rest, col(text), run, [("lang_pred", T.StringType()), ("score", T.DoubleType())])


def identify(docs: DataFrame) -> DataFrame:
    model = train(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), *model)
