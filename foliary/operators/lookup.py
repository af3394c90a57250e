"""What is new, changed, renamed or gone: the scan index and manifest snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Parts of a batch of index rows that are numbered side by side.
PARTS = 256


def last_by(index: DataFrame, key: str) -> DataFrame:
    """[W4] The last row of each key, by ord; of equal ones the last by path."""
    row = F.max_by(F.struct(*index.columns), F.struct(*[c for c in ("ord", "source_path", "note_path") if c in index.columns]))
    return index.groupBy(F.col(key).alias("__key")).agg(row.alias("r")).select("r.*")


def lookup(files: DataFrame, index: DataFrame) -> DataFrame:
    """[D1j] path, action (skip, rescan, rename, new), existing_note_path, old_source_path.

    By path first, then by fingerprint; each side keeps its last row. Fingerprints '' and
    'unknown' never match by themselves."""
    index = index.select("source_path", "fingerprint", "note_path", "ord")
    by_path = last_by(index, "source_path").select(F.col("source_path").alias("path"), F.col("fingerprint").alias("fp_p"), F.col("note_path").alias("note_p"))
    known = index.where(~F.col("fingerprint").isin("", "unknown"))
    by_fp = last_by(known, "fingerprint").select("fingerprint", F.col("source_path").alias("old"), F.col("note_path").alias("note_f"))
    joined = files.select("path", "fingerprint").join(by_path, "path", "left").join(by_fp, "fingerprint", "left")
    action = F.when(F.col("fp_p") == F.col("fingerprint"), "skip").when(F.col("fp_p").isNotNull(), "rescan").when(F.col("old").isNotNull(), "rename").otherwise("new")
    rename = F.col("action") == "rename"
    joined = joined.withColumn("action", action)
    return joined.select("path", "action", F.when(rename, F.col("note_f")).otherwise(F.col("note_p")).alias("existing_note_path"), F.when(rename, F.col("old")).alias("old_source_path"))


def verified_index(index: DataFrame, notes: DataFrame) -> DataFrame:
    """[A13] Index rows whose note exists; rows without a note stay."""
    return index.where("note_path = '' OR note_path IS NULL").unionByName(index.where("note_path <> ''").join(notes.select("note_path").distinct(), "note_path", "left_semi").select(*index.columns))


def ghosts(index: DataFrame, notes: DataFrame) -> DataFrame:
    """[D3j] Notes that the index names and that don't exist."""
    return index.where("note_path <> ''").select("note_path").distinct().join(notes.select("note_path"), "note_path", "left_anti")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """[D2j, D15j] path, change (new, modified, removed) between two snapshots of (path, size, mtime)."""
    side = lambda df, name: df.select("path", F.struct("size", "mtime").alias(name))
    both = side(old, "o").join(side(new, "n"), "path", "full_outer")
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def escalation(delta: DataFrame, old: DataFrame, total: int = 50, in_folder: int = 20) -> DataFrame:
    """[C18] One row: n_delta, n_new_folders (brand new with many files), escalate."""
    top = F.regexp_extract("path", r"^/?([^/]+)/", 1)
    live = delta.where("change <> 'removed'").withColumn("top", top)
    fresh = live.groupBy("top").count().where(F.col("count") > in_folder).join(old.select(top.alias("top")).distinct(), "top", "left_anti")
    sums = live.agg(F.count("*").alias("n_delta")).crossJoin(fresh.agg(F.count("*").alias("n_new_folders")))  # one row each
    return sums.withColumn("escalate", (F.col("n_delta") > total) | (F.col("n_new_folders") > 0))


def newest_snapshots(snapshots: DataFrame, keep: int = 2) -> DataFrame:
    """[B3, W8, A14] The snapshots (column snapshot) that stay: the newest few of the distinct ids."""
    ids = snapshots.select("snapshot").distinct().orderBy(F.desc("snapshot")).limit(keep)
    return snapshots.join(F.broadcast(ids), "snapshot", "left_semi")


def merge(index: DataFrame, decisions: DataFrame, files: DataFrame, start: int) -> DataFrame:
    """[T2, B1] Index rows to append for a batch of decisions; tabs and line breaks are refused. Every
    row has an ord of its own, counted on from start: parts of the batch are numbered side by side,
    each after the sizes of those before it."""
    rows = decisions.where("action <> 'skip'").join(files.select("path", "fingerprint"), "path")
    note = F.coalesce("existing_note_path", F.lit(""))
    clean = F.when(F.concat("path", note).rlike(r"[\t\n]"), F.raise_error(F.lit("a field holds a tab or a line break"))).otherwise(F.col("path"))
    rows = rows.select(F.pmod(F.xxhash64("path"), F.lit(PARTS)).alias("part"), clean.alias("source_path"), "fingerprint", note.alias("note_path"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))  # PARTS rows at most
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("source_path", "fingerprint", "note_path"))
    return rows.select("source_path", "fingerprint", "note_path", (F.lit(start) + F.col("before") + nth).cast("long").alias("ord"))
