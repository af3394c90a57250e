"""Logs of streams: replayed, broken off and restarted; sessions of late rows."""

import datetime
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliary import model
from foliary.streaming import deltas, logbook

ENTRY = "kind string, text string, k long"


def entries(batch, batch_id):
    return batch.select(F.lit(f"t{batch_id}").alias("timestamp"), F.col("kind").alias("event_type"), F.col("text").alias("summary"), F.lit(None).cast("string").alias("details"), F.col("k").alias("ord"))


def later(batch, batch_id):
    return batch.where("kind = 'a'").select(F.col("text").alias("path"), F.lit("new").alias("action"))


def batch(spark, n, start=0):
    return spark.createDataFrame([("ab"[k % 2], f"e{k}", k) for k in range(start, start + n)], ENTRY)


def state(spark, root):
    return (
        [(r.ord, r.summary) for r in logbook.log(spark, root).orderBy("ord").collect()],
        {r.event_type: r.n for r in logbook.counters(spark, root).collect()},
        sorted((r.batch, r.path) for r in logbook.deferred(spark, root).collect()),
    )


def test_empty_before_the_first(spark, tmp_path):
    assert state(spark, f"file://{tmp_path}/log") == ([], {}, [])


def test_a_batch_counts_once(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    run = logbook.record(root, entries, later, most=5)
    run(batch(spark, 4), 0)
    once = state(spark, root)
    run(batch(spark, 4), 0)
    assert state(spark, root) == once == ([(k, f"e{k}") for k in range(4)], {"a": 2, "b": 2}, [(0, "e0"), (0, "e2")])
    run(batch(spark, 3, 10), 1)
    run(batch(spark, 3, 10), 1)
    assert state(spark, root) == ([(2, "e2"), (3, "e3"), (14, "e10"), (15, "e11"), (16, "e12")], {"a": 4, "b": 3}, [(0, "e0"), (0, "e2"), (1, "e10"), (1, "e12")])


def test_broken_off_in_the_middle(spark, tmp_path):
    """The log is written, the deferred events fail: nothing of the batch counts till it is run again."""
    root = f"file://{tmp_path}/log"
    logbook.record(root, entries, later)(batch(spark, 4), 0)
    before = state(spark, root)
    broken = lambda rows, _: rows.select(F.raise_error(F.lit("no")).alias("path"), F.lit("new").alias("action"))
    with pytest.raises(PySparkException):
        logbook.record(root, entries, broken)(batch(spark, 2, 8), 1)
    assert state(spark, root) == before
    logbook.record(root, entries, later)(batch(spark, 2, 8), 1)
    assert state(spark, root)[1] == {"a": 3, "b": 3} and len(state(spark, root)[0]) == 6


def test_restart_from_the_checkpoint(spark, tmp_path):
    """A stream that fails in its second batch and is started again has logged every row once."""
    source, root, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "log", "cp"))
    for k in range(4):
        batch(spark, 5, 10 * k).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    failing = {"left": 1}

    def run(rows, batch_id):
        logbook.record(root, entries, later, most=8)(rows, batch_id)
        if batch_id == 1 and failing["left"]:  # the version is there, the checkpoint doesn't know
            failing["left"] -= 1
            raise RuntimeError("lost")

    start = lambda: spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(PySparkException):
        start().awaitTermination()
    start().awaitTermination()
    log, counts, put_off = state(spark, root)
    assert [s for _, s in log] == ["e22", "e23", "e24", "e30", "e31", "e32", "e33", "e34"]
    assert counts == {"a": 12, "b": 8} and len(put_off) == 12 and logbook.versions(spark, root) == [0, 1, 2, 3]
    logbook.prune(spark, root)
    assert state(spark, root) == (log, counts, put_off)


def test_decisions_are_deferred(spark, tmp_path):
    index, root = f"file://{tmp_path}/index", f"file://{tmp_path}/log"
    run = deltas.upsert(index, logbook.of_decisions(root, lambda: "now"))
    files = lambda *own: spark.createDataFrame(list(own), "path string, fingerprint string")
    run(files(("/a", "1"), ("/b", "2")), 0)
    run(files(("/a", "1"), ("/b", "3"), ("/c", "4")), 1)
    assert {(r.event_type, r.summary) for r in logbook.log(spark, root).collect()} == {("scan-new", "2 files"), ("scan-skip", "1 files"), ("scan-rescan", "1 files"), ("scan-new", "1 files")}
    assert sorted((r.batch, r.path, r.action) for r in logbook.deferred(spark, root).collect()) == [(0, "/a", "new"), (0, "/b", "new"), (1, "/b", "rescan"), (1, "/c", "new")]


def test_sessions_of_a_stream_with_late_rows(spark, tmp_path):
    """Sessions come out once the watermark has passed them; rows later than that are left out, others join."""
    source, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "cp"))
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    batches = [[(1, 0), (1, 3)], [(1, 5), (2, 40)], [(2, 41), (1, 41)], [(1, 1), (3, 90)], [(3, 200)]]  # (1, 1) comes after its session is out
    for rows in batches:
        spark.createDataFrame([(u, "t", day(d)) for u, d in rows], "user_id long, event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    stream = spark.readStream.schema("user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    deltas.sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.user_id, (r.start - day(0)).days, (r.end - day(0)).days, r.n_events) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, 5, 3), (1, 41, 41, 1), (2, 40, 41, 2), (3, 90, 90, 1)]
    assert model.LOG
