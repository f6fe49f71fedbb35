"""Streams of edits, progress, review items and speech. Each has a batch twin among the operators.

Late rows: 10 minutes of watermark unless the caller sets another; rows later than that are dropped,
and counted where `once` or `outcomes` is in the query and `Counts` listens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they arrive; ts as an instant."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(edits: DataFrame, gap: str = "15 seconds", late: str | None = LATE) -> DataFrame:
    """One flush for each burst of a user's edits (user_id, ts, v), when no more come for `gap`; `late` is None if `edits` has a watermark."""
    timed = edits.withWatermark("ts", late) if late else edits
    bursts = timed.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return bursts.agg(F.count("*").alias("n"), F.max_by("v", F.struct("ts", "v")).alias("last")).select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("flush_ts"), "n", "last")


def live_status(items: DataFrame) -> DataFrame:
    """The newest item of each talk, for update mode."""
    top = F.max_by(F.struct("number", "status"), F.struct("updated_at", "number")).alias("t")
    return items.where("status is not null").groupBy("talk_id").agg(top).select("talk_id", "t.number", "t.status")


def outcomes(progress: DataFrame, limit_ms: int = 600_000, whole: float = 0.98, late: str = LATE) -> DataFrame:
    """What becomes of each render: rows (render_id, state, at, best, exit_code) as they are certain.

    progress has render_id, ts, out_time, exit_code and total: rows of progress, and one with an exit
    code when the process ends. `stalled`: the greatest out_time has stood for over `limit_ms` since
    `at`; `failed`: the exit code is not 0; `truncated`: it is 0, but under `whole` of the total was
    reached; else `finished`. Rows after the exit do not count.

    Rows wait in the render's state until the watermark has passed them, so they are judged in order
    of event time however they arrive; one timer a row wakes them, one more tells of a stall that no
    row follows. State is held in the RocksDB store, which this sets for the session.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Render(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.head = handle.getValueState("head", "best long, since long, told boolean, ended boolean")
            self.waiting = handle.getListState("waiting", "us long, out_time long, exit_code int, total long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            if not (self.head.exists() and self.head.get()[3]):
                for part in rows:
                    named = part[["us", "out_time", "exit_code", "total"]].astype(object)
                    arrived = list(named.where(named.notna(), None).itertuples(index=False, name=None))
                    self.waiting.appendList([tuple(None if v is None else int(v) for v in r) for r in arrived])
                    for us in {int(r[0]) for r in arrived}:
                        self.handle.registerTimer(us // 1000 + 1)
            yield pd.DataFrame(columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs() * 1000
            best, since, told, ended = self.head.get() if self.head.exists() else (None, None, False, False)
            rows = list(self.waiting.get()) if self.waiting.exists() and not ended else []
            due = sorted((r for r in rows if r[0] < now), key=lambda r: (r[0], r[2] is not None, r[1] or 0))
            found = []

            def stands(until: int) -> bool:
                return since is not None and not told and until - since > limit_ms * 1000

            for us, out, code, total in due:
                if stands(us):
                    found.append((key[0], "stalled", since, best, None))
                    told = True
                if code is not None:
                    state = "failed" if code else "truncated" if best is None or best < whole * total else "finished"
                    found.append((key[0], state, us, best, code))
                    ended = True
                    break
                if since is None or (out is not None and (best is None or out > best)):
                    best, since, told = out, us, False
            if not ended and stands(now):
                found.append((key[0], "stalled", since, best, None))
                told = True
            self.head.update((best, since, told, ended))
            rest = [] if ended else [r for r in rows if r[0] >= now]
            self.waiting.put(rest) if rest else self.waiting.clear()
            if not ended and since is not None and not told:
                self.handle.registerTimer((since + limit_ms * 1000) // 1000 + 1)
            yield pd.DataFrame(found, columns=names)

        def close(self) -> None:
            pass

    names = ["render_id", "state", "us", "best", "exit_code"]
    progress.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = progress.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).select("render_id", "ts", "us", "out_time", "exit_code", "total")
    made = timed.groupBy("render_id").transformWithStateInPandas(Render(), "render_id long, state string, us long, best long, exit_code int", "Append", "EventTime")
    return made.select("render_id", "state", F.timestamp_micros("us").alias("at"), "best", "exit_code")


def rewinds(segments: DataFrame, limit_ms: int = 20_000) -> DataFrame:
    """Segments (video_id, seg_id, start_ms, end_ms) that start over `limit_ms` behind what their video had reached."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reached = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seg_id")
        found: list[tuple[int, int, int]] = []
        for seg, a, z in zip(rows["seg_id"], rows["start_ms"], rows["end_ms"], strict=True):
            if reached is not None and reached - a > limit_ms:
                found.append((key[0], int(seg), int(reached - a)))
            reached = z if reached is None else max(reached, z)
        state.update((int(reached),))
        yield pd.DataFrame(found, columns=["video_id", "seg_id", "rewind_ms"])

    return segments.groupBy("video_id").applyInPandasWithState(step, "video_id long, seg_id long, rewind_ms long", "reached long", "append", GroupStateTimeout.NoTimeout)


class Counts(StreamingQueryListener):
    """Rows in and rows dropped as too late, for each named query; `spark.streams.addListener(Counts())`.

    Rows in are those that `once` observes; late ones are those that the query's stateful operators
    drop, being behind the watermark of the batch before. `once` and `outcomes` drop row by row; an
    aggregation drops what is left after a task has combined its rows.
    """

    def __init__(self) -> None:
        self.rows: Counter[str] = Counter()
        self.late: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get("arrived") if p.observedMetrics else None
        self.rows[p.name] += seen["rows"] if seen is not None else 0
        self.late[p.name] += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


def once(stream: DataFrame, *keys: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    """`stream` with a watermark, each (keys, ts) once though it be delivered again, late rows dropped and counted.

    Its rows and greatest event time are observed, so that they stand in each progress report as `arrived`.
    """
    seen = stream.observe("arrived", F.count(F.lit(1)).alias("rows"), F.max(ts).alias("newest"))
    return seen.withWatermark(ts, late).dropDuplicates([*keys, ts])


def newest_files(batch: DataFrame, key: str = "video_id") -> DataFrame:
    """Of rows with `file` and `changed` those of each key's newest file."""
    last = batch.groupBy(key).agg(F.max_by("file", F.struct("changed", "file")).alias("file"))
    return batch.join(last, [key, "file"], "left_semi")


def write_batch(verdicts: DataFrame, number: int, sink: str) -> None:
    """Puts a batch's verdicts in the place of that batch: written again, they are not there twice."""
    numbered = verdicts.withColumn("batch", F.lit(number).cast("long"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)


def newest_verdicts(spark: SparkSession, sink: str, key: str = "video_id") -> DataFrame:
    """The verdict of each key in its newest batch."""
    order = Window.partitionBy(key).orderBy(F.desc("batch"))
    return spark.read.parquet(sink).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "batch")


def changed_files(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive, with the `file` that each is from and when that was `changed`."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    return reader.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))


def on_changed(changes: DataFrame, check, sink: str, checkpoint: str):
    """Runs `check` on the newest files of each batch of `changes` and writes its verdicts under `sink`, a folder a batch.

    A batch that is run again after a failure replaces its own verdicts. Returns the started query; it
    stops when what has arrived is done.
    """

    def each(batch: DataFrame, number: int) -> None:
        write_batch(check(newest_files(batch).drop("file", "changed")), number, sink)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
