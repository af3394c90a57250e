"""Sinks: snapshots, index rows, notes and attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary import model
from foliary.operators.rows import first_seen, newest


def write_manifest(manifest: DataFrame, root: str, snapshot: int) -> None:
    """[B2] One folder per snapshot; Spark's committer makes it appear whole."""
    manifest.select("path", "size", "mtime").write.mode("overwrite").parquet(f"{root}/snapshot={snapshot}")


def snapshots(spark: SparkSession, root: str) -> dict[int, str]:
    """Folders of the snapshots that were written whole, by id: names from the file system, no rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot=*/_SUCCESS")) or []]
    return {int(p.getParent().getName().split("=")[1]): p.getParent().toString() for p in names}


def newest_manifest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """[A14, W8] The newest whole snapshot (older than `before`); no other folder is listed by the read. No rows
    without one."""
    found = {k: p for k, p in snapshots(spark, root).items() if before is None or k < before}
    if not found:
        return spark.createDataFrame([], model.MANIFEST + ", snapshot long")
    last = max(found)
    return spark.read.schema(model.MANIFEST).parquet(found[last]).withColumn("snapshot", F.lit(last).cast("long"))


def prune_manifests(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """[B3] Deletes all but the newest whole snapshots; returns the deleted ids."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = snapshots(spark, root)
    gone = sorted(found, reverse=True)[keep:]
    for k in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found[k]), True)
    return sorted(gone)


def checked_index_rows(rows: DataFrame) -> DataFrame:
    """[B1] The rows; a tab or line break in a field fails the job."""
    bad = F.concat_ws("", "source_path", "fingerprint", "note_path").rlike(r"[\t\n]")
    return rows.withColumn("source_path", F.when(bad, F.raise_error(F.lit("a field holds a tab or a line break"))).otherwise(F.col("source_path")))


def append_index(rows: DataFrame, path: str) -> None:
    """[B1]"""
    checked_index_rows(rows).write.mode("append").parquet(path)


def write_attachments(rows: DataFrame, path: str) -> None:
    """[B5] sha256, filename, first_seen by sha256: the first of each content."""
    first_seen(rows, "sha256", "filename").orderBy("sha256").write.mode("overwrite").parquet(path)


def capped_log(old: DataFrame, new: DataFrame, most: int = 200) -> DataFrame:
    """[B6, T7] The newest entries of both, new ones counted on from the old."""
    start = F.coalesce(F.max("ord"), F.lit(-1)) + 1
    shifted = new.join(F.broadcast(old.agg(start.alias("start"))), F.lit(True)).withColumn("ord", F.col("ord") + F.col("start")).drop("start")  # one row
    return newest(old.unionByName(shifted), most)


def new_notes(notes: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """[B8] Notes that may be written: creating never replaces one."""
    return notes if overwrite else notes.join(existing.select("note_path"), "note_path", "left_anti")


def appended(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """[B10] note_path, body with its section at the end; without one as it is."""
    joined = notes.join(sections, "note_path", "left")
    return joined.select("note_path", F.when(F.col("section").isNull(), F.col("body")).otherwise(F.concat(F.regexp_replace("body", r"\s+$", ""), F.lit("\n\n"), "section", F.lit("\n"))).alias("body"))


def guarded(rendered: DataFrame, present: DataFrame) -> DataFrame:
    """[B12, R17] name, target (file, sidecar, none): a file that was edited by hand, so that its text no
    longer has the hash it carries, is left alone and the new text goes beside it."""
    own = present.select("name", F.col("text").alias("was"), (F.sha2(F.col("text").cast("binary"), 256) != F.col("stored_hash")).alias("edited"))
    both = rendered.join(own, "name", "left")
    return both.select("name", F.when(F.col("was") == F.col("text"), "none").when(F.coalesce("edited", F.lit(False)), "sidecar").otherwise("file").alias("target"))
