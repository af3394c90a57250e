"""Checks over all notes at once, as rows of (check, note, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.operators import detect, links, rows, validate


def missing_attachments(notes: DataFrame, files: DataFrame) -> DataFrame:
    """[D17j] note, attachment of attachments (array) that aren't among files (name)."""
    each = notes.select("note", F.explode("attachments").alias("attachment"))
    return each.join(files.select(F.col("name").alias("attachment")), "attachment", "left_anti").select("note", "attachment")


def broken_sources(notes: DataFrame, archive: DataFrame) -> DataFrame:
    """[D18j, C12] Notes whose source isn't in the archive; notes without an archive are exempt."""
    return notes.where("source_path <> ''").join(archive.select(F.col("path").alias("source_path")), "source_path", "left_anti")


def stale_renames(index: DataFrame, notes: DataFrame) -> DataFrame:
    """[D16j] Notes whose own source path isn't the index's."""
    own = notes.select("note_path", F.col("source_path").alias("own"))
    return index.select("note_path", "source_path").join(own, "note_path").where("source_path <> own")


#: The seven checks.
CHECKS = ["orphan", "broken-source", "schema", "repeated", "stale-rename", "missing-attachment", "body"]


def health(notes: DataFrame, index: DataFrame, archive: DataFrame, files: DataFrame | None = None, stop_words: list[str] = ()) -> DataFrame:
    """[R11] notes (note_path, stem, body, source_path, fm, and attachments where there are files) ->
    check, note, detail of all seven checks; `reports.check_counts` has their tallies [E11]."""
    said = detect.compose_gate(notes.select("note_path", "body", F.lit("").alias("text"), F.lit(0).alias("images"), F.lit(None).cast("array<string>").alias("captions")), stop_words)
    say = lambda df, check, note, detail: df.select(F.lit(check).alias("check"), F.col(note).alias("note"), detail.alias("detail"))
    parts = [
        say(links.orphans(notes.select("stem", "body")), "orphan", "stem", F.lit("")),
        say(broken_sources(notes, archive), "broken-source", "note_path", F.col("source_path")),
        say(validate.violations(notes).where("pos = 0"), "schema", "note_path", F.col("violation")),
        say(rows.repeated(index), "repeated", "key", F.col("kind")),
        say(stale_renames(index, notes), "stale-rename", "note_path", F.col("source_path")),
        say(said.select("note_path", F.explode("reasons").alias("reason")), "body", "note_path", F.col("reason")),
    ]
    if files is not None:
        parts.append(say(missing_attachments(notes.select(F.col("note_path").alias("note"), "attachments"), files), "missing-attachment", "note", F.col("attachment")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
