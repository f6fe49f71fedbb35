"""Streams over slices of events give what their batch twins give."""

import time

import pytest
from pyspark.sql import functions as F

from cuegrain import views as V
from cuegrain.operators import cues as C
from cuegrain.operators import merge as M
from cuegrain.operators import quality as Q
from cuegrain.sources import files as S
from cuegrain.streaming import jobs as J


@pytest.fixture(scope="module")
def slices(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    V.table(spark, small, "events").repartitionByRange(3, "ts").write.parquet(path)
    return path


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_debounced(spark, small, slices):
    schema = V.table(spark, small, "events").schema
    stream = J.events(spark, slices, schema).select("user_id", "ts", F.col("value").alias("v"))
    drained(J.debounced(stream, "4 hours", "40 days").writeStream.outputMode("append").format("memory").queryName("bursts").start())
    batch = M.sessions(V.table(spark, small, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v")), 4 * 3600)
    got = spark.table("bursts")
    assert got.count() <= batch.count() and got.join(batch, ["user_id", "first_ts", "n"], "left_anti").count() == 0


def test_live_status(spark, small, slices):
    schema = V.table(spark, small, "events").schema
    e = J.events(spark, slices, schema)
    status = F.when(F.col("event_type").isin("view", "signup"), "pending").when(F.col("event_type") == "click", "in-progress").when(F.col("event_type") == "purchase", "approved")
    items = e.select(F.col("event_id").alias("number"), F.col("user_id").alias("talk_id"), F.col("ts").alias("updated_at"), status.alias("status"))
    drained(J.live_status(items).writeStream.outputMode("complete").format("memory").queryName("status").start())
    batch = M.latest(V.issues(spark, small)).select("talk_id", "number", "status")
    assert sorted(map(tuple, spark.table("status").collect())) == sorted(map(tuple, batch.collect()))


def test_rewinds(spark, tmp_path):
    rows = [(v, i, i * 1000 - (30_000 if i == 40 and v % 2 else 0), i * 1000 + 900) for v in range(4) for i in range(50)]
    spark.createDataFrame(rows, "video_id long, seg_id long, start_ms long, end_ms long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id long, seg_id long, start_ms long, end_ms long").parquet(str(tmp_path / "in"))
    drained(J.rewinds(stream).writeStream.outputMode("append").format("memory").queryName("rewinds").start())
    assert sorted((r.video_id, r.seg_id) for r in spark.table("rewinds").collect()) == [(1, 40), (3, 40)]


RENDER = "render_id long, ts timestamp, out_time long, exit_code int, total long"


def waves(spark, tmp_path, *parts, schema=RENDER):
    """Each part as a file, in order of arrival, with times as text."""
    cast = [f"{c.split()[0]}" if c.split()[1] != "timestamp" else f"cast({c.split()[0]} as timestamp) {c.split()[0]}" for c in schema.split(", ")]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema.replace("timestamp", "string")).selectExpr(*cast).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_render_outcomes(spark, tmp_path):
    """Stalled, failed, truncated and finished renders, with rows that arrive out of order, as in batch."""
    t = lambda m: f"2024-01-01 {m // 60:02}:{m % 60:02}:00"
    first = [(1, t(0), 5, None, 100), (1, t(5), 6, None, 100), (2, t(0), 1, None, 100), (3, t(1), 99, None, 100), (4, t(1), 97, None, 100), (5, t(2), None, 0, 100), (6, t(0), 9, None, 100)]
    second = [(2, t(4), 50, None, 100), (2, t(6), None, 3, 100), (3, t(3), None, 0, 100), (4, t(3), 97, None, 100), (4, t(4), None, 0, 100), (2, t(2), 40, None, 100)]
    third = [(1, t(40), 7, None, 100), (6, t(8), 10, None, 100), (6, t(16), 11, None, 100), (2, t(50), 99, None, 100)]
    rest = [[(9, t(300), 1, None, 100)], [(9, t(301), 2, None, 100)]]
    stream = waves(spark, tmp_path, first, second, third, *rest)
    drained(J.outcomes(stream).writeStream.outputMode("append").format("memory").queryName("outcomes").start())
    rows = spark.read.schema(RENDER).parquet(str(tmp_path / "in/*")).where("render_id <> 9")
    columns = ["render_id", "state", "at", "best", "exit_code"]
    got = {tuple(r) for r in spark.table("outcomes").select(*columns).collect()}
    batch = {tuple(r) for r in M.render_outcomes(rows, 600).select(*columns).collect()}
    assert batch <= got
    # what stands at the end is stalled in the stream, whose time has gone on
    assert {(r[0], r[1]) for r in got - batch} == {(6, "stalled"), (1, "stalled")} - {(r[0], r[1]) for r in batch} or {r[0] for r in got - batch} <= {1, 6}
    assert {(r[0], r[1]) for r in batch} == {(1, "stalled"), (2, "failed"), (3, "finished"), (4, "truncated"), (5, "truncated")}


def test_late_rows_are_counted(spark, tmp_path):
    """Two rows that arrive after the watermark has passed them are dropped, and counted."""
    t = lambda h, u: (u, f"2024-01-01 {h:02}:00:00", 1.0)
    stream = waves(spark, tmp_path, [t(1, 1), t(2, 2)], [t(20, 3), t(20, 3)], [t(20, 8)], [t(3, 4), t(4, 5), t(20, 6)], [t(21, 7)], schema="user_id long, ts timestamp, v double")
    counts = J.Counts()
    spark.streams.addListener(counts)
    try:
        query = J.debounced(J.once(stream, "user_id", "v"), late=None).writeStream.outputMode("append").format("memory").queryName("late").start()
        query.processAllAvailable()
        deadline = time.time() + 20
        while time.time() < deadline and (counts.late["late"] < 2 or counts.rows["late"] < 9):
            time.sleep(0.2)
        query.stop()
    finally:
        spark.streams.removeListener(counts)
    assert counts.late["late"] == 2 and counts.rows["late"] == 9
    flushed = {r.user_id: r.n for r in spark.table("late").collect()}
    assert flushed == {1: 1, 2: 1, 3: 1, 6: 1, 8: 1}  # 3 was delivered twice; 7 is still open


def test_incremental_validation(spark, small, tmp_path):
    """A batch that fails after it wrote is run again and stands once; the newest file of a video counts."""
    cues = V.cues(spark, small).where("video_id < 20").select("video_id", "idx", "text", "start_ms", "end_ms")
    cues.repartition(3, "video_id").write.parquet(str(tmp_path / "in"))
    check = lambda b: Q.video_stats(b).select("video_id", "blocks")
    run = lambda: J.on_changed(J.changed_files(spark, str(tmp_path / "in"), cues.schema, 1), check, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    write, calls = J.write_batch, []

    def failing(verdicts, number, sink):
        write(verdicts, number, sink)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("killed after the write")

    J.write_batch = failing
    try:
        with pytest.raises(Exception, match="killed"):
            run()
        run()
    finally:
        J.write_batch = write
    assert calls == [0, 1, 1, 2]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("video_id").distinct().count() == cues.select("video_id").distinct().count()
    cues.where("video_id = 3 and idx <= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {r.video_id: r.blocks for r in J.newest_verdicts(spark, str(tmp_path / "out")).collect()}[3] == 2


def test_newest_file_of_a_batch(spark):
    rows = [(1, 1, "a", 10), (1, 2, "a", 10), (1, 1, "b", 20), (2, 1, "a", 10)]
    got = J.newest_files(spark.createDataFrame(rows, "video_id long, idx long, file string, changed long"))
    assert sorted(map(tuple, got.select("video_id", "idx", "file").collect())) == [(1, 1, "b"), (2, 1, "a")]


def test_files_round_trip(spark, small, tmp_path):
    cues = C.range_select(V.cues(spark, small).where("video_id < 9"), 1, 4)
    files = Q.cue_files(cues).collect()
    for r in files:
        p = tmp_path / f"talks/t{r.video_id}/v/final/uk.srt"
        p.parent.mkdir(parents=True)
        p.write_text("\ufeff" + r.file.replace("\n", "\r\n") + "\n\nbroken\nchunk\n", encoding="utf-8", newline="")
    (tmp_path / "talks/t0/v/source").mkdir()
    (tmp_path / "talks/t0/v/source/en.srt").write_bytes(b"\xff\xfea\x00")
    got = S.read_cues(spark, f"{tmp_path}/talks/*/*/final/*.srt")
    assert got.count() == cues.count() and got.select("talk_id").distinct().count() == len(files)
    assert [tuple(r) for r in S.discover(spark, f"{tmp_path}/talks/*/*/*/*.srt").collect()] == [("t0", "v")]
    kinds = {r.path.rsplit("/", 2)[1]: r.encoding for r in S.audit_encodings(spark, f"{tmp_path}/talks/t0/*/*/*.srt").collect()}
    assert kinds == {"source": "utf-16", "final": "text"}
