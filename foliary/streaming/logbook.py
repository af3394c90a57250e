"""What a stream keeps beside its index: a log with a ceiling, counters, and deferred events. [T5, T7, B6]

Each batch writes a version: the log so far, the counters so far, and the events that the batch
itself defers. A version counts once its marker is there, which is written last; so the three
change together, and a batch that is run again, after a failure or a restart from the
checkpoint, finds its version whole and leaves it, or writes it anew from the one before it.

The log and the counters are bounded (entries by `most`, counters by the kinds of events), so
that a version is small, however long the stream runs. Deferred events stay in the version of
their batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary import model
from foliary.sources.writers import capped_log

DONE = "_DONE"
COUNTERS = "event_type string, n long"
DEFERRED = "path string, action string"
Entries = Callable[[DataFrame, int], DataFrame]


def _files(spark: SparkSession, root: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The batches whose versions are whole, in order."""
    path, fs = _files(spark, root)
    found = fs.globStatus(path(f"{root}/version=*/{DONE}")) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def _table(spark: SparkSession, root: str, version: int | None, name: str, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{root}/version={version}/{name}")


def log(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The entries of the newest whole version (of a batch before `before`); empty before the first."""
    own = [v for v in versions(spark, root) if before is None or v < before]
    return _table(spark, root, own[-1] if own else None, "log", model.LOG)


def counters(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """event_type, n of all entries there ever were, also those that the log's ceiling has put out."""
    own = [v for v in versions(spark, root) if before is None or v < before]
    return _table(spark, root, own[-1] if own else None, "counters", COUNTERS)


def deferred(spark: SparkSession, root: str) -> DataFrame:
    """path, action, batch of all events that whole versions have deferred."""
    own = versions(spark, root)
    if not own:
        return spark.createDataFrame([], DEFERRED + ", batch long")
    rows = spark.read.schema(DEFERRED).parquet(*[f"{root}/version={v}/deferred" for v in own])
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/version=(-?\d+)/", 1).cast("long"))


def record(root: str, entries: Entries, later: Entries | None = None, most: int = 200) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: entries(batch, id) gives rows of the log, ord being their order within the
    batch; later(batch, id) the events (path, action) that it defers."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in versions(spark, root):
            return
        at = f"{root}/version={batch_id}"
        batch = batch.persist()  # read three times; what is lost with an executor is computed again
        try:
            new = entries(batch, batch_id)
            capped_log(log(spark, root, batch_id), new, most).write.mode("overwrite").parquet(f"{at}/log")
            counts = new.groupBy("event_type").agg(F.count("*").alias("n")).unionByName(counters(spark, root, batch_id))
            counts.groupBy("event_type").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{at}/counters")
            rows = later(batch, batch_id) if later else spark.createDataFrame([], DEFERRED)
            rows.select("path", "action").write.mode("overwrite").parquet(f"{at}/deferred")
        finally:
            batch.unpersist()
        path, fs = _files(spark, root)
        fs.create(path(f"{at}/{DONE}"), True).close()

    return run


def of_decisions(root: str, now: Callable[[], str], most: int = 200) -> Callable[[DataFrame, int], None]:
    """[T5] For deltas.upsert: one log entry for each kind of decision of a batch, and the files that would
    need prose, which an unattended run leaves for later."""

    def entries(batch: DataFrame, batch_id: int) -> DataFrame:
        counts = batch.groupBy("action").agg(F.count("*").alias("n"))
        order = F.array_position(F.array(*map(F.lit, ["new", "rescan", "rename", "skip"])), F.col("action"))
        return counts.select(F.lit(now()).alias("timestamp"), F.concat(F.lit("scan-"), "action").alias("event_type"), F.concat(F.col("n").cast("string"), F.lit(" files")).alias("summary"), F.lit(None).cast("string").alias("details"), order.cast("long").alias("ord"))

    return record(root, entries, lambda batch, _: batch.where("action IN ('new', 'rescan')"), most)


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes logs and counters of all but the newest whole versions; deferred events stay."""
    path, fs = _files(spark, root)
    for v in versions(spark, root)[:-keep]:
        for name in ("log", "counters"):
            fs.delete(path(f"{root}/version={v}/{name}"), True)
