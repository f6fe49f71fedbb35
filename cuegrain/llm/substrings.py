"""Removal of repeated byte strings by suffix sorting, over all documents at once.

A string of LENGTH bytes that also starts earlier (a smaller id, or the same document, earlier)
is removed, each byte that one covers. Equal strings must meet in one task though no task may
hold the corpus, so:

1. Each window of LENGTH bytes picks its anchor, the run of ANCHOR bytes in it with the least
   hash; equal windows pick equal anchors at equal offsets. Windows in a row with one anchor
   are a run: a piece of text and its number of windows. Runs, as hashes, are grouped by anchor.
2. Of runs with one text the earliest stays and the others' windows are removed. Runs whose
   anchor occurs with another text too may still share some windows.
3. Those are cut in two at the windows with half their other bytes before the anchor; such a
   half shares a window with another only if it also shares those half of the bytes, so it is
   grouped by anchor and these. Groups are sorted as suffixes (see suffixes.py), many small
   groups to one text of about TEXT symbols: bytes, and one symbol for the bytes that a group
   shares. Windows that are neighbours in suffix order are compared symbol by symbol, and of
   equal ones all but the earliest are removed. A group of more
   than GROUP halves is dealt over several such texts, and the earliest of each text's equal
   windows are compared again by a 128-bit hash.
4. Removed windows are gathered by document as intervals and cut from the text.

Whole copies of an earlier text are told first, by SHA-256, and need no runs.

Rows are told by their id and a hash of their text (`mark`), never by the id alone. Anchors on
many rows of a sample are dealt over SALTS tasks: of the rows with one run each task keeps the
earliest, and only those are compared over all tasks.

Defined cases: a null text is empty; texts under LENGTH bytes keep all; rows that share an id
are in the order of their marks, and if they share the text too they are equally early, do not
remove each other and keep the same; a null id comes before all others and is shared by all rows
without one; a text of any size is cut in segments with LENGTH - 1 bytes in common; other columns
are not needed; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, pieces, ship, staged
from .hashing import Rolling, mix
from .suffixes import suffix_array

LENGTH, ANCHOR = 100, 32
SPAN = LENGTH - ANCHOR + 1
HALF = (LENGTH - ANCHOR) // 2
CORE = ANCHOR + HALF
BIN, TEXT, GROUP = 48_000, 8_000, 256
SEGMENT = 1 << 23
NO_ID = -(1 << 63)
#: Share of the rows sampled for anchors on many rows, the most rows of that sample, the share of its runs that is many, and tasks for each.
SAMPLED, MOST_SAMPLED, MANY, SALTS = 0.01, 1_000_000, 1 / 2000, 256


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from running minima of blocks of that width, forward and back."""
    n = len(keys) - width + 1
    full = -(-len(keys) // width) * width
    padded = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of all texts in `buf`, which begin at `edges`: text number, start in it, windows, anchor's offset, its hash, the run's hash."""
    out = []
    for at in range(0, max(1, len(buf) - LENGTH + 1), SEGMENT):
        part = buf[at : at + SEGMENT + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n <= 0:
            continue
        rolling = Rolling(part)
        grams = rolling.windows(ANCHOR)
        position = np.uint64((1 << 24) - 1)
        anchor = (_least((grams & ~position) | np.arange(len(grams), dtype=np.uint64), SPAN) & position).astype(np.int64)
        inside = np.zeros(n + 1, dtype=np.int64)
        first = np.clip(edges[:-1] - at, 0, n)
        last = np.clip(edges[1:] - at - LENGTH + 1, 0, n)
        some = last > first
        np.add.at(inside, first[some], 1)
        np.add.at(inside, last[some], -1)
        valid = np.cumsum(inside[:-1]) > 0
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])) + 1
        start = np.concatenate(([0], change))
        stop = np.concatenate((change, [n]))
        keep = valid[start]
        start, stop = start[keep], stop[keep]
        doc = np.searchsorted(edges, start + at, side="right") - 1
        out.append((doc, start + at - edges[doc], stop - start, anchor[start] - start, grams[anchor[start]], rolling.ranges(start, stop + LENGTH - 1)))
    if not out:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    edges = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=edges[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), edges


def _covered(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals as they are, with those that touch or overlap in a document made one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    reach = np.maximum.accumulate(stop + doc * (1 << 40)) - doc * (1 << 40)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))[: len(doc)]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(stop, at) if len(at) else stop


def occurrences(docs: DataFrame) -> DataFrame:
    """anchor, run, doc_id, mark, place, stop of every run that is its document's first of that text.

    place holds start, windows and anchor offset and sorts by start; stop is 0. Later runs of a text
    in one document, which periodic text has by the thousand, are removed for certain: they come as
    rows with a stop, joined to intervals, whose place is their start and whose anchor is of no use.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2)):
                doc, start, count, offset, anchor, text = runs(*_buffer(batch.column(2).slice(a, b - a)))
                order = np.lexsort((start, text, anchor, doc))
                same = (doc[order][1:] == doc[order][:-1]) & (anchor[order][1:] == anchor[order][:-1]) & (text[order][1:] == text[order][:-1])
                later = np.zeros(len(doc), dtype=bool)
                later[order[1:][same]] = True
                d, s, z = _covered(doc[later], start[later], start[later] + count[later] + LENGTH - 1)
                first = ~later
                of = np.concatenate((doc[first], d))
                columns = (
                    np.concatenate((anchor[first], mix(s.astype(np.uint64) + (d.astype(np.uint64) << np.uint64(32))))).view(np.int64),
                    np.concatenate((text[first].view(np.int64), np.zeros(len(d), dtype=np.int64))),
                    *(batch.column(c).slice(a, b - a).to_numpy()[of] for c in (0, 1)),
                    np.concatenate(((start << 16 | count << 8 | offset)[first], s)),
                    np.concatenate((np.zeros(int(first.sum()), dtype=np.int64), z)),
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "run", "doc_id", "mark", "place", "stop"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "anchor long, run long, doc_id long, mark long, place long, stop long")


def frequent_anchors(docs: DataFrame) -> DataFrame:
    """Anchors of at least a share MANY of the runs of a sample: no more than 1 / MANY of them, whatever the table."""
    share = min(SAMPLED, MOST_SAMPLED / max(docs.count(), 1))
    some = occurrences(docs.where(F.pmod(F.xxhash64("doc_id", "mark", F.lit("anchors")), F.lit(1_000_003)) < int(1_000_003 * share) + 1))
    counts = staged(some.where("stop = 0").groupBy("anchor").agg(F.count("*").alias("c")), "anchor-sample")
    total = counts.agg(F.sum("c")).first()[0] or 0
    return counts.where(F.col("c") >= max(8.0, MANY * total)).select("anchor", F.lit(True).alias("frequent"))


def _place_of(run: Column) -> tuple[Column, Column, Column]:
    return run["doc_id"], run["mark"], run["place"]


def _is_later(first: Column) -> Column:
    """Whether this run begins after `first`; windows give the rows that are equally early one first."""
    (d, m, p), (fd, fm, fp) = (F.col("doc_id"), F.col("mark"), F.col("place")), _place_of(first)
    return (d > fd) | (m > fm) & (d == fd) | (p > fp) & (m == fm) & (d == fd)


def compare_runs(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """Runs that an earlier equal one removes (`again`), and earliest ones whose anchor has other runs too."""
    kept = ("doc_id", "mark", "place", "stop", "again")
    salted = found.join(F.broadcast(frequent), "anchor", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    salted = salted.withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS))).otherwise(0))
    same = Window.partitionBy("anchor", "salt", "run").orderBy("doc_id", "mark", "place")
    all_ = Window.partitionBy("anchor", "salt")
    first = F.first(F.struct("doc_id", "mark", "place")).over(same)
    marked = salted.repartition("anchor", "salt").select("*", first.alias("_f"), (F.min("run").over(all_) != F.max("run").over(all_)).alias("others"))
    marked = marked.withColumn("again", (F.col("stop") == 0) & _is_later(F.col("_f")))
    some = marked.where("again or others or frequent or stop > 0").select("anchor", "run", *kept, (F.col("frequent") & ~F.col("again") & (F.col("stop") == 0)).alias("open"))
    some = staged(some, "compared")
    # what the tasks of a frequent anchor left: equal runs are few now, and which anchors have other runs is a small table
    open_ = some.where("open")
    others = open_.groupBy("anchor").agg((F.min("run") != F.max("run")).alias("others"))
    over_all = Window.partitionBy("anchor", "run").orderBy("doc_id", "mark", "place")
    rest = open_.withColumn("_f", F.first(F.struct("doc_id", "mark", "place")).over(over_all)).withColumn("again", _is_later(F.col("_f")))
    rest = rest.join(F.broadcast(others), "anchor").where("again or others").select(*kept)
    return some.where("not open").select(*kept).unionByName(rest)


def halves(docs: DataFrame, varied: DataFrame) -> DataFrame:
    """key, doc_id, mark, start, at, piece: both halves of each varied run, keyed by the CORE bytes at `at`, its anchor and half the bytes around it, which all its windows hold."""
    by_doc = varied.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))
    joined = docs.join(by_doc, ["doc_id", "mark"]).select("doc_id", "mark", "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2)):
                buf, edges = _buffer(batch.column(2).slice(a, b - a))
                lists = batch.column(3).slice(a, b - a)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                place = lists.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(b - a), sizes)
                start, count, offset = place >> 16, place >> 8 & 0xFF, place & 0xFF
                begin = edges[doc] + start
                anchor = begin + offset
                # windows that begin HALF or more bytes before the anchor, and the others
                early = np.clip(offset - HALF + 1, 0, count)
                rolling = Rolling(buf)
                ids, marks = (batch.column(c).slice(a, b - a).to_numpy()[doc] for c in (0, 1))
                for side, (some, first, number, left, right) in enumerate((
                    (early > 0, begin, early, anchor - HALF, anchor - HALF + CORE),
                    (early < count, begin + early, count - early, anchor, anchor + CORE),
                )):
                    at = np.flatnonzero(some)
                    if not len(at):
                        continue
                    key = rolling.ranges(left[at], right[at]) ^ np.uint64(side)
                    raw = [buf[f : f + c + LENGTH - 1].tobytes() for f, c in zip(first[at].tolist(), number[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(ids[at]), pa.array(marks[at]), pa.array((first - edges[doc])[at]), pa.array((left - first)[at]), pa.array(raw, pa.binary())],
                        names=["key", "doc_id", "mark", "start", "at", "piece"],
                    )

    return joined.mapInArrow(cut, "key long, doc_id long, mark long, start long, at long, piece binary")


def _merged(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that windows at `start` cover; windows in a row become one."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)) + 1
    a, z = np.concatenate(([0], cut)), np.concatenate((cut, [len(doc)])) - 1
    return doc[a], start[a], start[z] + LENGTH


def sort_windows(pieces_: list[bytes], at: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of the pieces in suffix order: piece, document (a number in their order), start, class of equal windows, whether earliest.

    The CORE bytes that all windows of a piece hold are one symbol of the sorted text, named by their
    bytes; equal windows hold the same core at the same place, so they are equal symbol by symbol.
    """
    size = np.array([len(p) for p in pieces_], dtype=np.int64)
    edges = np.concatenate(([0], np.cumsum(size + 1)))
    flat = np.frombuffer(b"\x00".join(pieces_) + b"\x00", dtype=np.uint8)
    text = flat.astype(np.int64) + 1
    text[edges[1:] - 1] = 0
    core = (edges[:-1] + at)[:, None] + np.arange(CORE)
    text[core[:, 0]] = 257 + np.unique(flat[core].view(f"S{CORE}").ravel(), return_inverse=True)[1]
    kept = np.ones(len(text), dtype=bool)
    kept[core[:, 1:].ravel()] = False
    text, edges, width = text[kept], edges - (CORE - 1) * np.arange(len(edges)), LENGTH - CORE + 1
    order = suffix_array(text)
    piece = np.searchsorted(edges, order, side="right") - 1
    whole = order + width < edges[piece + 1]
    order, piece = order[whole], piece[whole]
    windows = np.lib.stride_tricks.sliding_window_view(text, width)
    same = np.zeros(len(order), dtype=bool)
    for i in range(1, len(order), 16384):
        j = min(len(order), i + 16384)
        same[i:j] = (windows[order[i:j]] == windows[order[i - 1 : j - 1]]).all(axis=1)
    group = np.cumsum(~same)
    d, s = doc[piece], start[piece] + order - edges[piece]
    by = np.lexsort((s, d, group))
    group, d, s, piece = group[by], d[by], s[by], piece[by]
    head = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.empty(0, dtype=bool)
    earliest = np.flatnonzero(head)
    first = np.repeat(earliest, np.diff(np.append(earliest, len(group))))
    later = (d > d[first]) | (s > s[first])  # sorted, so never before it
    return piece, d, s, later, head


def texts(key: np.ndarray, symbols: np.ndarray) -> list[np.ndarray]:
    """Numbers of the pieces, by texts of about TEXT symbols, in which a key's pieces are together; small ones are sorted faster a symbol."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    text = (np.cumsum(symbols[order]) - symbols[order])[new] // TEXT
    return np.split(order, np.flatnonzero(new)[1:][text[1:] != text[:-1]])


def compare_halves(cut: DataFrame) -> DataFrame:
    """doc_id, mark, start, stop: the windows of `cut` that an earlier equal one removes, as intervals."""
    sizes = staged(cut.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "half-sizes")
    parts = F.when(F.col("c") > GROUP, F.ceil(F.col("c") / GROUP)).otherwise(1)
    dealt = join_hot(cut, sizes, "key", "c").where("c is not null").withColumn("dealt", F.col("c") > GROUP).withColumn("part", F.pmod(F.xxhash64("doc_id", "mark", "start"), parts))
    dealt = staged(dealt.select("key", "part", "dealt", "doc_id", "mark", "start", "at", "piece"), "halves")
    total = dealt.agg(F.sum(F.length("piece") - (CORE - 1))).first()[0] or 0
    bins = max(1, -(-total // BIN))

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        ids, marks, start = (table[c].to_numpy() for c in ("doc_id", "mark", "start"))
        by = np.lexsort((marks, ids))
        new = np.concatenate(([True], (ids[by][1:] != ids[by][:-1]) | (marks[by][1:] != marks[by][:-1])))
        doc = np.empty(len(ids), dtype=np.int64)
        doc[by] = np.cumsum(new) - 1
        ids, marks = ids[by][new], marks[by][new]
        split = table["dealt"].to_numpy(zero_copy_only=False)
        whole = table["piece"].to_pylist()
        at, symbols = table["at"].to_numpy(), np.array([len(p) - CORE + 1 for p in whole])
        found = []
        for some in texts(table["key"].to_numpy(), symbols):
            of, *sorted_ = sort_windows([whole[i] for i in some.tolist()], at[some], doc[some], start[some])
            found.append((some[of], *sorted_))
        of, d, s, later, head = (np.concatenate(x) for x in zip(*found, strict=True))
        out_doc, out_start, out_stop = _merged(d[later], s[later]) if later.any() else (d[:0], s[:0], s[:0])
        names = ["doc_id", "mark", "start", "stop", "window"]
        rows = pa.table([pa.array(ids[out_doc]), pa.array(marks[out_doc]), pa.array(out_start), pa.array(out_stop), pa.nulls(len(out_doc), pa.binary())], names=names)
        open_ = np.flatnonzero(head & split[of])
        if len(open_):
            places = zip(of[open_].tolist(), (s[open_] - start[of[open_]]).tolist(), strict=True)
            hashes = pa.array([hashlib.blake2b(whole[p][o : o + LENGTH], digest_size=16).digest() for p, o in places], pa.binary())
            d, s = d[open_], s[open_]
            rows = pa.concat_tables([rows, pa.table([pa.array(ids[d]), pa.array(marks[d]), pa.array(s), pa.array(s + LENGTH), hashes], names=names)])
        return rows

    # sorting takes long for its bytes, so the number of tasks is set here, not by their size
    keyed = dealt.withColumn("_bin", F.pmod(F.xxhash64("key", "part"), F.lit(bins))).repartition(min(-(-bins // 8), 50_000), "_bin")
    found = staged(keyed.groupBy("_bin").applyInArrow(sort, "doc_id long, mark long, start long, stop long, window binary"), "removed-windows")
    marked = found.where("window is not null")
    first = marked.groupBy("window").agg(F.min(F.struct("doc_id", "mark", "start")).alias("_f"), F.count("*").alias("_c")).where("_c > 1")
    later = marked.join(first, "window").where(F.struct("doc_id", "mark", "start") > F.col("_f"))
    return found.where("window is null").drop("window").unionByName(later.select("doc_id", "mark", "start", "stop"))


def row_key() -> tuple[Column, Column]:
    """What tells rows apart: the id, and a hash of the text among rows that share it."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, mark, start, stop (bytes) of what an earlier equal string removes; intervals may overlap."""
    docs = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text"))
    named = staged(docs.where(F.octet_length("text") >= LENGTH).select("doc_id", "mark", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n")), "texts")
    first = staged(named.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1"), "first-copies")
    whole = join_hot(named, first, "sha", "c").where("doc_id > first")  # copies with one id have one mark: equally early
    whole = staged(whole.select("doc_id", "mark", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")), "whole-copies")
    others = docs.join(whole.select("doc_id", "mark").distinct(), ["doc_id", "mark"], "left_anti")
    compared = compare_runs(occurrences(others), frequent_anchors(docs))
    start, count = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255)
    again = compared.where("again").select("doc_id", "mark", start.alias("start"), (start + count + (LENGTH - 1)).alias("stop"))
    own = compared.where("stop > 0").select("doc_id", "mark", F.col("place").alias("start"), "stop")
    varied = compared.where("not again and stop = 0").select("doc_id", "mark", "place")
    return whole.unionByName(again).unionByName(own).unionByName(compare_halves(staged(halves(others, varied), "cut-runs")))


def cut(docs: DataFrame, intervals: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept of each document."""
    by_doc = intervals.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set(F.struct("start", "stop")).alias("_s"))
    key, mark = row_key()
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_id"), mark.alias("_mark")).join(by_doc, ["_id", "_mark"], "left")
    joined = joined.select("doc_id", "text", F.transform("_s", lambda x: x["start"]).alias("_a"), F.transform("_s", lambda x: x["stop"]).alias("_z"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                size, removed, spans, kept = [], [], [], []
                for i in range(a, b):
                    raw = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                    size.append(len(raw))
                    if not batch.column(2)[i].is_valid:
                        removed.append(0)
                        spans.append(0)
                        kept.append(raw)
                        continue
                    step = np.zeros(len(raw) + 1, dtype=np.int64)
                    np.add.at(step, batch.column(2)[i].values.to_numpy(), 1)
                    np.add.at(step, batch.column(3)[i].values.to_numpy(), -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                    kept.append(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(x, pa.int64()) for x in (size, removed, spans)], pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup(docs: DataFrame) -> DataFrame:
    """The bytes of each document without strings that start earlier, with what was removed."""
    docs = docs.select("doc_id", "text")
    ship(docs.sparkSession)
    return cut(docs, repeated(docs))


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
