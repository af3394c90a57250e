"""Which project a folder's files belonged to before, by majority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.paths import archive_parent, has_prefix, project_of_note
from foliary.operators.lookup import last_by


def matched(samples: DataFrame, index: DataFrame) -> DataFrame:
    """[D9j] samples (folder, ord, fingerprint) with the index row that last had the fingerprint."""
    usable = samples.where("fingerprint <> ''")
    known = last_by(index.where(~F.col("fingerprint").isin("", "unknown")), "fingerprint").select("fingerprint", "source_path", "note_path")
    return usable.join(known, "fingerprint", "left")


def majority(rows: DataFrame, winner: Column) -> DataFrame:
    """[E1] folder, winner, match_count, total_checked, confidence. Ties go to the one met first."""
    counted = rows.withColumn("winner", winner)
    totals = counted.groupBy("folder").agg(F.count("*").alias("total_checked"))
    votes = counted.where("note_path IS NOT NULL").groupBy("folder", "winner").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = votes.groupBy("folder").agg(F.max_by(F.struct("winner", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("b"))
    return best.join(totals, "folder").select("folder", "b.winner", F.col("b.n").alias("match_count"), "total_checked", (F.col("b.n") / F.col("total_checked")).alias("confidence"))


def renames(samples: DataFrame, index: DataFrame, min_matches: int = 3, threshold: float = 0.5, layout: str = "legacy") -> DataFrame:
    """[D7j, R15] Folders whose files were filed under another project name."""
    won = majority(matched(samples, index), project_of_note(F.col("note_path"), layout))
    return won.where((F.col("match_count") >= min_matches) & (F.col("confidence") >= threshold) & (F.col("winner") != F.col("folder"))).withColumnRenamed("winner", "old_name")


def project_notes(index: DataFrame, project: str) -> DataFrame:
    """[R15] The notes of a project, whose frontmatter is to name another after a rename."""
    return index.where(F.startswith("note_path", F.lit(project + "/"))).select("note_path").distinct()


def repairs(moved: DataFrame, index: DataFrame, layout: str = "domain") -> DataFrame:
    """[R14] note_path, source_path (the new one) of the notes whose sources moved (folder, old_parent,
    new_parent); to be read before the index is rewritten. Of a note's sources the last by path counts."""
    join = lambda parent: F.concat(F.regexp_replace(parent, "/$", ""), F.lit("/"), F.col("folder"))
    rows = index.where("note_path <> ''").withColumn("folder", project_of_note(F.col("note_path"), layout)).join(moved.select("folder", "old_parent", "new_parent"), "folder")
    old = join(F.col("old_parent"))
    rows = rows.where(has_prefix(F.col("source_path"), old))
    new = F.concat(join(F.col("new_parent")), F.substring(F.col("source_path"), F.char_length(old) + 1, F.lit(1 << 30)))
    return rows.groupBy("note_path").agg(F.max(new).alias("source_path"))


def moves(samples: DataFrame, index: DataFrame, min_matches: int = 3, threshold: float = 0.5) -> DataFrame:
    """[D8j, R14] Folders (with their present parent in column parent) whose files were under
    another archive parent, the project name being the same."""
    rows = matched(samples, index)
    project = project_of_note(F.col("note_path"))
    won = majority(rows, F.struct(project.alias("project"), archive_parent(F.col("source_path"), project).alias("parent")))
    now = samples.groupBy("folder").agg(F.min("parent").alias("new_parent"))
    won = won.join(now, "folder").where((F.col("winner.project") == F.col("folder")) & (F.col("winner.parent") != F.col("new_parent")))
    won = won.where((F.col("match_count") >= min_matches) & (F.col("confidence") >= threshold))
    return won.select("folder", F.col("winner.parent").alias("old_parent"), "new_parent", "match_count", "total_checked", "confidence")
