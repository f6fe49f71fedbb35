"""What the training-data operators share: inputs, staged tables and Arrow batching."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import shared_dir, staged

__all__ = ["SPACE", "WORD", "col", "join_hot", "mapped", "numbered", "pieces", "row_of", "shared_dir", "ship", "staged", "table", "without"]

#: A word, as the contracts define it: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Python works through an Arrow batch in pieces of about this many bytes, whatever the batch holds.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of `df` but those named, in any case of letters."""
    lower = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in lower]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def row_of(df: DataFrame, names: list[str]) -> Column:
    """The named columns as one struct, `_row`, so that names of any kind pass through Arrow; `_row.*` gives them back."""
    return F.struct(*map(col, names), *([] if names else [F.lit(0).alias("none")])).alias("_row")


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], rows: str, most: int = 1000, total: int | None = None) -> DataFrame:
    """`left` with the row of `right` (one for each `key`) that has its key, if any; a key may be on any share of `left`.

    `rows` counts a key's rows in `left`. Keys with a `most`-th part of all rows or more are at most
    `most`, so their rows of `right` are broadcast; the other keys are joined by shuffle. A null key
    finds nothing and is not shuffled. `total` saves counting the rows of `left`, if they are known.
    """
    bound = max(2.0, (left.count() if total is None else total) / most)
    on = [key] if isinstance(key, str) else key
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    hot = F.broadcast(right.where(F.col(rows) >= bound).withColumn("_hot", F.lit(True)))
    first = left.join(hot, on, "left")
    rest = first.where(F.col("_hot").isNull() & ~no_key).select(*left.columns).join(right.where(F.col(rows) < bound).hint("shuffle_merge"), on, "left")
    return first.where(F.col("_hot").isNotNull() | no_key).drop("_hot").unionByName(rest)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` (tree, ...) with `idx`, the place of each row among its tree's rows in `order`, and `size`, their number.

    The place in a sorted partition, plus the rows of the same tree in partitions before it: one row for each partition and tree.
    """
    ordered = df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part).withColumn("_row", row).drop("_at")
    runs = placed.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    by_part = Window.partitionBy("tree").orderBy("_part")
    before = F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    # small enough tables are broadcast; a join by shuffle meets no key with more rows than a sorted partition
    found = placed.join(staged(offsets, f"{name}-offsets"), ["tree", "_part"])
    return found.withColumn("idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def mapped(df: DataFrame, keep: list[str], value: Column, run, made: list[tuple[str, T.DataType]]) -> DataFrame:
    """The columns `keep` of `df` and those that `run` makes of `value`, an Arrow batch at a time.

    `run` takes batches of two columns, the kept ones as a struct and the value, and gives batches
    of that struct and the columns in `made`.
    """
    source = df.select(row_of(df, keep), value.alias("_value"))
    schema = source.select("_row").schema
    for name, kind in made:
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema).select(*(["_row.*"] if keep else []), *[name for name, _ in made])


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)
