"""Longest rising subsequences and best monotone pairings, one sorted pass over each group's rows.

Rows are partitioned by group and sorted, so a task streams its groups one after another and holds
the keys of one of them; nothing but keys, order and values goes through Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_rising(rows: DataFrame, order: str, value: str, strict: bool = True, key: str = "video_id") -> DataFrame:
    """The rows (key, order, value) of a longest subsequence, in order of `order`, whose values rise, or do not fall unless `strict`.

    By patience sorting with predecessor links: each row is linked to the last one before it that
    ends a chain one shorter, and the chain that ends lowest among the longest is kept. So a few
    rows far off the course drop out themselves, wherever they stand. `order` is unique within a key;
    rows with a null in either column are left out.
    """
    names = [key, order, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left, bisect_right

        place = bisect_left if strict else bisect_right
        current, orders, values, tails, ends, links = None, [], [], [], [], []
        out: tuple[list, list, list] = ([], [], [])
        schema = None

        def close() -> None:
            at = ends[-1] if ends else -1
            chain = []
            while at >= 0:
                chain.append(at)
                at = links[at]
            for i in reversed(chain):
                out[0].append(current)
                out[1].append(orders[i])
                out[2].append(values[i])
            for part in (orders, values, tails, ends, links):
                part.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], names=names)
            for part in out:
                part.clear()
            return made

        for batch in batches:
            schema = batch.schema
            for k, o, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if orders and k != current:
                    close()
                    if len(out[0]) > 100_000:
                        yield flush()
                current = k
                n = place(tails, v)
                tails[n : n + 1] = [v]
                ends[n : n + 1] = [len(orders)]
                links.append(ends[n - 1] if n else -1)
                orders.append(o)
                values.append(v)
        if schema is not None:
            close()
            yield flush()

    sorted_rows = rows.select(*names).dropna(subset=[order, value]).repartition(key).sortWithinPartitions(key, order)
    return sorted_rows.mapInArrow(run, sorted_rows.schema)


def best_pairing(cells: DataFrame, groups: list[str], a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """Of scored cells (groups, a, b, score) the pairing that rises in both and has the greatest sum of scores.

    The dynamic program runs over the cells alone, in order of a, with the best chain that ends
    before each b in a tree of prefix maxima: exact, at n log n for n cells, without a band. Of equal
    sums the chain with the lower cell comes first, at each step.
    """
    names = [*groups, a, b, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        current, cells_, schema = None, [], None
        out: list[list] = [[] for _ in names]

        def close() -> None:
            ranks = sorted({c[1] for c in cells_})
            tree: list[tuple | None] = [None] * (len(ranks) + 1)  # (sum, -cell) at best
            best, links = [0] * len(cells_), [-1] * len(cells_)

            def before(n: int) -> tuple | None:
                top = None
                while n > 0:
                    if tree[n] is not None and (top is None or tree[n] > top):
                        top = tree[n]
                    n -= n & -n
                return top

            i = 0
            while i < len(cells_):
                j = i
                while j < len(cells_) and cells_[j][0] == cells_[i][0]:
                    top = before(bisect_left(ranks, cells_[j][1]))
                    best[j] = cells_[j][2] + (top[0] if top else 0)
                    links[j] = -top[1] if top else -1
                    j += 1
                for k in range(i, j):
                    n, entry = bisect_left(ranks, cells_[k][1]) + 1, (best[k], -k)
                    while n < len(tree):
                        if tree[n] is None or entry > tree[n]:
                            tree[n] = entry
                        n += n & -n
                i = j
            at = max(range(len(cells_)), key=lambda k: (best[k], -k), default=-1)
            while at >= 0:
                for column, v in zip(out, (*current, *cells_[at]), strict=True):
                    column.append(v)
                at = links[at]
            cells_.clear()

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cells_ and row[:-3] != current:
                    close()
                current = row[:-3]
                cells_.append(row[-3:])
        if schema is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], names=names)

    sorted_cells = cells.select(*names).repartition(*groups).sortWithinPartitions(*groups, a, b)
    return sorted_cells.mapInArrow(run, sorted_cells.schema)
