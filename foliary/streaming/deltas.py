"""Polled deltas: each micro-batch is looked up against the index and appended to it.

A file stream never tells of edits or deletions, so a batch is a whole listing or its
changed part, and the comparison is the batch operator's. The lookup has two keys (path
and fingerprint), so it can't be keyed state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliary import model
from foliary.operators import lookup


def index_table(spark: SparkSession, path: str) -> DataFrame:
    """All batches of the index so far; empty before the first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(model.INDEX + ", batch long").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], model.INDEX + ", batch long")


def upsert(index_path: str, decided: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """[T1, T2, T5] A foreachBatch function over (path, fingerprint). A batch's rows are written to
    their own folder, so a batch that is run again replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = index_table(spark, index_path).where(F.col("batch") < batch_id)
        start = (index.agg(F.max("ord")).first()[0] or 0) + 1
        files = batch.select("path", "fingerprint").dropDuplicates(["path"])
        decisions = lookup.lookup(files, index.drop("batch"))
        if decided:
            decided(decisions, batch_id)
        lookup.merge(index.drop("batch"), decisions, files, start).write.mode("overwrite").parquet(f"{index_path}/batch={batch_id}")

    return run


def start(files: DataFrame, index_path: str, checkpoint: str, decided: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """[T3] One query per checkpoint, which is what excludes a second writer."""
    return files.writeStream.foreachBatch(upsert(index_path, decided)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "7 days", late: str = "1 day") -> DataFrame:
    """[W1 as a stream] Islands of activity per user and type, with a watermark; batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", "event_type", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_events")).drop("w")
