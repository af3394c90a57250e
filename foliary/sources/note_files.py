"""Notes and binary files written one by one, as a Python data source with a writer.

    write(rows, root)                     # rows: path, text or content; or path, part, text
    acknowledged(rows, root)              # what has been written, read back

A task writes each file whole under a temporary name in `_pending`, with a list of what it has
written; files it finds unchanged aren't written. The commit gives them their names, so no file
is ever seen half-written; a failed job's pending files are removed by its abort, those of a
killed one by `sweep`. A file that exists is kept, or replaced where `overwrite` is set. Tasks
that are tried again write under other temporary names, and only the ones that the commit names
count.

A file may come in parts: rows of one path with `part` are written one after another in its
order, by one task with an open file, so that a file may be larger than a row.

Paths are relative to the root and stay below it; others fail the job. Null or empty texts give
empty files, null paths none. Of rows that repeat a path (and part) any may count, as they are
written in the order of their part and content; give each once.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PENDING = "_pending"
FORMAT = "foliary_files"
#: Renames of a commit at once.
THREADS = 16


def file_system(root: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(root) if "://" in root else (arrow_fs.LocalFileSystem(), root)


@dataclass
class Written(WriterCommitMessage):
    """The list of a task's files, which is a file itself: messages stay small."""

    listed: str | None


class FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str, run: str, replace: bool):
        self.root, self.run, self.replace = root.rstrip("/"), run, replace

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = file_system(self.root)
        own = posixpath.join(root, PENDING, self.run, f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}")
        store.create_dir(own, recursive=True)
        done = []

        def rows() -> Iterator[tuple[str, bytes]]:
            for batch in iterator:
                for path, body in zip(batch.column("path"), batch.column("content"), strict=True):
                    if path.is_valid:
                        yield path.as_py(), body.as_py() or b""

        for path, parts in groupby(rows(), key=lambda r: r[0]):
            clean = posixpath.normpath(path)
            if clean.startswith(("/", "..")) or clean in (".", PENDING) or clean.startswith(PENDING + "/"):
                raise ValueError(f"not a path below the root: {path}")
            target, temporary = posixpath.join(root, clean), posixpath.join(own, str(len(done)))
            there = store.get_file_info(target)
            if there.type != arrow_fs.FileType.NotFound and not self.replace:
                continue
            size, digest = 0, hashlib.sha256()
            with store.open_output_stream(temporary) as out:
                for _, part in parts:
                    out.write(part)
                    size += len(part)
                    digest.update(part)
            if there.type == arrow_fs.FileType.File and there.size == size and digest_of(store, target) == digest.digest():
                store.delete_file(temporary)
                continue
            done.append({"from": temporary, "to": target})
        if not done:
            store.delete_dir(own)
            return Written(None)
        listed = posixpath.join(own, "list")
        with store.open_output_stream(listed) as out:
            out.write("\n".join(map(json.dumps, done)).encode())
        return Written(listed)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = file_system(self.root)

        def publish(one: dict) -> None:
            if not self.replace and store.get_file_info(one["to"]).type != arrow_fs.FileType.NotFound:
                return  # written by someone else meanwhile
            store.create_dir(posixpath.dirname(one["to"]), recursive=True)
            store.move(one["from"], one["to"])

        with ThreadPoolExecutor(THREADS) as pool:
            for message in messages:
                if message and message.listed:
                    with store.open_input_stream(message.listed) as lines:
                        list(pool.map(publish, map(json.loads, lines.read().decode().split("\n"))))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = file_system(self.root)
        pending = posixpath.join(root, PENDING, self.run)
        if store.get_file_info(pending).type != arrow_fs.FileType.NotFound:
            store.delete_dir(pending)


def digest_of(store: arrow_fs.FileSystem, path: str) -> bytes:
    digest = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.digest()


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:  # noqa: ANN001
        return FileWriter(self.options["path"], uuid.uuid4().hex, self.options.get("replace", "false") == "true")


def content_of(rows: DataFrame) -> DataFrame:
    """path, part, content of rows with text or content, and maybe part."""
    content = F.col("content") if "content" in rows.columns else F.col("text").cast("binary")
    part = F.col("part") if "part" in rows.columns else F.lit(0)
    return rows.select("path", part.alias("part"), content.alias("content"))


def write(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """[B7, B8, B9, B10, B13] Creates a file for each path, or replaces it."""
    rows.sparkSession.dataSource.register(FileSink)
    ready = content_of(rows).where("path is not null")
    if "part" in rows.columns:
        ready = ready.repartition("path").sortWithinPartitions("path", "part")
    ready.select("path", "content").write.format(FORMAT).mode("append").option("path", root).option("replace", str(overwrite).lower()).save()


def read(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), content of all files there but pending and empty ones, which Spark's reader leaves out."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.substring(F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:(?://[^/]*)?", ""), len(base) + 2, F.lit(1 << 30))
    return files.select(below.alias("path"), "content").where(~F.startswith("path", F.lit(PENDING + "/")))


def has_files(spark: SparkSession, root: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def acknowledged(rows: DataFrame, root: str) -> DataFrame:
    """[B9] path, bytes_written, sha256, ok, error of rows (path, maybe expected): of the bytes that executors
    read back from the files, not of those that were sent. A file that isn't there or can't be read is an
    error, as is one that has another digest than was expected; null paths have no file."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        for batch in batches:
            out = []
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("expected").to_pylist(), strict=True):
                try:
                    target = posixpath.join(base, posixpath.normpath(path))
                    size, digest = store.get_file_info(target).size, digest_of(store, target).hex()
                    error = None if expected in (None, digest) else "another digest than expected"
                    out.append((path, size, digest, error is None, error))
                except Exception as e:  # one file never fails the others
                    said = "not written" if isinstance(e, FileNotFoundError) else f"{type(e).__name__}: {e}"
                    out.append((path, None, None, False, said))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "bytes_written", "sha256", "ok", "error"])

    asked = rows.where("path is not null").select("path", F.col("expected") if "expected" in rows.columns else F.lit(None).cast("string").alias("expected"))
    return asked.mapInArrow(look, "path string, bytes_written long, sha256 string, ok boolean, error string")


def write_acknowledged(rows: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """[B9]"""
    write(rows, root, overwrite)
    return acknowledged(rows, root)


def append_sections(sections: DataFrame, root: str) -> DataFrame:
    """[B10] Puts sections (path, section) at the ends of existing notes; gives those of which no note is there.
    Null sections change nothing."""
    there = read(sections.sparkSession, root).select("path", F.col("content").cast("string").alias("body"))
    body = F.concat(F.regexp_replace("body", r"\s+$", ""), F.lit("\n\n"), "section", F.lit("\n"))
    write(there.join(sections.where("section is not null"), "path").select("path", body.alias("text")), root, overwrite=True)
    return sections.where("section is not null").join(there, "path", "left_anti")


def sweep(root: str) -> None:
    """Removes what killed jobs have left; only while no job writes there."""
    store, base = file_system(root)
    pending = posixpath.join(base, PENDING)
    if store.get_file_info(pending).type != arrow_fs.FileType.NotFound:
        store.delete_dir(pending)
