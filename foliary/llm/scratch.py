"""Intermediate tables in the folder that the cluster shares.

A job that uses a result twice writes it here and reads it back: that cuts the
lineage, survives lost executors, and keeps column pruning for later readers.

What an operator returns may read its tables lazily. So those stay until the caller has
written the result and calls `clear`, or at the latest until the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset, a folder of our own on a local
    master, as in tests; elsewhere an error, as executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="foliary-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Where this thread's new tables are noted, if anywhere.
_collecting: ContextVar[list[Scratch] | None] = ContextVar("collecting", default=None)


@contextmanager
def collecting() -> Iterator[list[Scratch]]:
    """The list of what is made within: for callers that delete the tables of one step and no others."""
    own: list[Scratch] = []
    token = _collecting.set(own)
    try:
        yield own
    finally:
        _collecting.reset(token)


class Scratch:
    """A folder of named Parquet tables."""

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/foliary/{label}-{uuid.uuid4().hex}"
        path, files = self._path(self.root)
        files.deleteOnExit(path)
        Scratch.live.append(self)
        own = _collecting.get()
        if own is not None:
            own.append(self)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing returned depends on."""
        for name in names:
            path, files = self._path(f"{self.root}/{name}")
            files.delete(path, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # else the application has ended, and with it the tables
            path, files = self._path(self.root)
            files.delete(path, True)
        if self in Scratch.live:
            Scratch.live.remove(self)

    def _path(self, path: str) -> tuple:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def clear() -> None:
    """Deletes all tables so far: for callers that have written what the operators returned."""
    for scratch in list(Scratch.live):
        scratch.close()


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches, as texts may be very long: bounded memory in Python workers. These
    settings of the session stay, as results are computed after the operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
