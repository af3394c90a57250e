"""Listings from systems of one's own, as a Python data source.

    register(spark, "mine", lister)            # lister(root) yields (path, size, mtime)
    spark.read.format("mine").option("roots", "a,b").load()
"""

from __future__ import annotations

import multiprocessing
import queue
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliary import model

#: Files that a task reads at once, and files whose contents it gives out together.
SLOTS, TOGETHER = 4, 64
Lister = Callable[[str], Iterator[tuple[str, int, int]]]


class Root(InputPartition):
    def __init__(self, root: str):
        self.root = root


def register(spark: SparkSession, name: str, lister: Lister) -> None:
    """[A5] One task per root."""

    class Reader(DataSourceReader):
        def __init__(self, roots: list[str]):
            self.roots = roots

        def partitions(self) -> list[InputPartition]:
            return [Root(r) for r in self.roots]

        def read(self, partition: Root) -> Iterator[tuple]:
            yield from lister(partition.root)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return model.MANIFEST

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader([r for r in self.options.get("roots", "").split(",") if r])

    spark.dataSource.register(Source)


class Slot:
    """A process that reads one file at a time and can be killed."""

    def __init__(self, read: Callable[[str], bytes]):
        self.read, self.process = read, None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")  # read needn't be importable
        self.pipe, other = context.Pipe()

        def serve() -> None:
            while (path := other.recv()) is not None:
                try:
                    other.send((self.read(path), None))
                except Exception as e:  # one file never fails the others
                    other.send((None, f"{type(e).__name__}: {e}"))

        self.process = context.Process(target=serve, daemon=True)
        self.process.start()
        other.close()

    def fetch(self, path: str, seconds: float) -> tuple[str, bytes | None, str | None, float]:
        began = time.monotonic()
        content, error = None, None
        try:
            if self.process is None or not self.process.is_alive():
                self._start()
            self.pipe.send(path)
            if self.pipe.poll(seconds):
                content, error = self.pipe.recv()
            else:
                error = "timeout"
                self.close()
        except (EOFError, OSError):
            error = "the reader died"
            self.close()
        return path, content, error, time.monotonic() - began

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None


def fetch(files: DataFrame, read: Callable[[str], bytes], seconds: float = 30.0, slots: int = SLOTS) -> DataFrame:
    """[A3, A4] path, content, error, seconds: each file within its own time; errors are rows.

    A task reads some files at once, each in a process; one that takes too long is killed and another
    takes its place, so that every file has an outcome of its own, however many hang."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Slot(read) for _ in range(slots)]
        free: queue.SimpleQueue[Slot] = queue.SimpleQueue()
        for slot in own:
            free.put(slot)

        def one(path: str) -> tuple:
            slot = free.get()
            try:
                return slot.fetch(path, seconds)
            finally:
                free.put(slot)

        try:
            with ThreadPoolExecutor(slots) as pool:
                for pdf in frames:
                    for k in range(0, len(pdf), TOGETHER):
                        yield pd.DataFrame(list(pool.map(one, pdf["path"][k : k + TOGETHER])), columns=["path", "content", "error", "seconds"])
        finally:
            for slot in own:
                slot.close()

    return files.select("path").where("path is not null").mapInPandas(run, "path string, content binary, error string, seconds double")
