"""The whole scan: files to decisions, notes' facts, and project pages."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions import dates, text
from foliary.operators import clusters, links, lookup, pages, routing
from foliary.session import written
from foliary.sources import note_files


def scan(files: DataFrame, index: DataFrame, skips: list[str] = ()) -> DataFrame:
    """[R22] files (path, size, mtime, fingerprint, text) -> one row per file that isn't skipped as
    unchanged: its date, decision, category, confidence and why it would have no note."""
    kept = routing.keep_segments(files, list(skips))
    decided = lookup.lookup(kept, index).where("action <> 'skip'")
    rows = routing.handler(kept).join(decided, "path")
    parts = F.split("path", "/")
    dated = dates.event_date(F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.col("mtime"))
    rows = rows.withColumn("d", dated).withColumn("confidence", text.confidence(F.col("text")))
    empty = F.coalesce("skip_reason", F.when(F.col("confidence") == "none", "no_content"))
    return rows.select("path", "action", "existing_note_path", "old_source_path", "d.event_date", F.col("d.source").alias("event_date_source"), "category", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("read_bytes"), "confidence", empty.alias("skip_reason"))


def heartbeat(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[T1, T4] (delta without removals, escalation row) between two manifests."""
    delta = lookup.diff(old, new)
    return delta.where("change <> 'removed'"), lookup.escalation(delta, old)


def project_pages(events: DataFrame, today: datetime.date) -> DataFrame:
    """[R1, R4] project, page: status, parties, timeline and navigation of every project."""
    head = clusters.status(events, today)
    named = head.join(clusters.parties(events), "project", "left").join(clusters.gantt(events), "project", "left").join(clusters.navigation(events).withColumnRenamed("block", "nav"), "project", "left")
    front = F.concat(F.lit("---\nproject: "), text.yaml_quote(F.col("project")), F.lit("\nstatus: "), "status", F.lit("\ntimeline_start: "), F.col("timeline_start").cast("string"), F.lit("\n---"))
    people = F.concat(F.lit("## Parties\n\n"), "parties")
    return named.select("project", F.concat_ws("\n\n", front, F.concat(F.lit("# "), "project"), people, F.concat(F.lit("## Timeline\n\n"), "block"), F.concat(F.lit("## Substructures\n\n"), "nav")).alias("page"))


PART = "struct<section:int,start:date,folder:string,kind:int,island:long,at:date,name:string,line:string>"


def page_parts(events: DataFrame, today: datetime.date) -> DataFrame:
    """[R1-R4] project, part, text: the pages of project_pages in pieces, which one after another, in the order of
    part, are the page. A piece is a line or a heading, so no row grows with a project; the file sink
    puts them together."""

    def part(section: int, text: Column, **at: Column) -> list[Column]:
        values = {"start": "date", "folder": "string", "kind": "int", "island": "long", "at": "date", "name": "string", "line": "string"}
        fields = [F.lit(section).alias("section"), *[at.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in values.items()]]
        return [F.col("project"), F.struct(*fields).cast(PART).alias("part"), text.alias("text")]

    head = clusters.status(events, today).join(clusters.parties(events), "project", "left")
    front = F.concat(F.lit("---\nproject: "), text.yaml_quote(F.col("project")), F.lit("\nstatus: "), "status", F.lit("\ntimeline_start: "), F.col("timeline_start").cast("string"), F.lit("\n---"))
    rows = head.select(*part(0, F.concat_ws("\n\n", front, F.concat(F.lit("# "), "project"), F.concat(F.lit("## Parties\n\n"), "parties"))))
    bars = clusters.labels(events).withColumn("first", F.min("start").over(Window.partitionBy("project", "folder")))
    dated = bars.select("project").distinct()
    title = F.concat(F.lit("\n\n## Timeline\n\n```mermaid\ngantt\n    title "), text.gantt_escape(F.col("project")), F.lit("\n    dateFormat YYYY-MM-DD"))
    rows = rows.union(dated.select(*part(1, title))).union(dated.select(*part(3, F.lit("\n```"))))
    folders = bars.select("project", "folder", "first").distinct()
    rows = rows.union(folders.select(*part(2, F.concat(F.lit("\n    section "), text.gantt_escape(F.col("folder"))), start=F.col("first"), folder=F.col("folder"), kind=F.lit(0))))
    rows = rows.union(bars.select(*part(2, F.concat(F.lit("\n"), clusters.bar()), start=F.col("first"), folder=F.col("folder"), kind=F.lit(1), island=F.col("island"))))
    lines = events.where("subfolder <> ''").withColumn("line", text.timeline_line(F.col("event_date"), F.col("note_filename"), F.col("summary_hint"), F.col("fallback_hint")))
    subfolders = lines.select("project", "subfolder").distinct()
    several = subfolders.groupBy("project").agg(F.min("subfolder").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    name = F.concat(F.when(F.col("subfolder") == F.col("least"), "\n\n## Substructures").otherwise(""), F.lit("\n\n### "), "subfolder", F.lit("/"))
    rows = rows.union(subfolders.join(several, "project").select(*part(4, name, folder=F.col("subfolder"), kind=F.lit(0))))
    line = part(4, F.concat(F.lit("\n"), "line"), folder=F.col("subfolder"), kind=F.lit(1), at=F.col("event_date"), name=F.col("note_filename"), line=F.col("line"))
    return rows.union(lines.join(several, "project").where("line IS NOT NULL").select(*line)).where("text IS NOT NULL")


def changed_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """[R6] Pages to be written: new ones and those that differ but for white space at their ends."""
    return new.join(old.select("project", F.col("page").alias("was")), "project", "left").where("was IS NULL OR trim(was) <> trim(page)").select("project", "page")


def update_pages(events: DataFrame, root: str, today: datetime.date, start: str = pages.START, end: str = pages.END) -> DataFrame:
    """[R6, B8] Reads the pages below root (project.md), generates those of the events' projects anew, keeps what users
    wrote in them, and writes the ones that have changed, each whole. Returns project, page of these.

    start and end are the markers around what is generated, for pages that other tools have written. A page is
    one row here; pages of very many events are written by page_parts."""
    spark = events.sparkSession
    old = note_files.read(spark, root) if note_files.has_files(spark, root) else spark.createDataFrame([], "path string, content binary")
    old = old.where(F.col("path").rlike(r"^[^/]+\.md$")).select(F.regexp_replace("path", r"\.md$", "").alias("project"), F.col("content").cast("string").alias("page"))
    changed = written(changed_pages(old, pages.regenerated(project_pages(events, today), old, start, end)), "changed-pages")
    note_files.write(changed.select(F.concat("project", F.lit(".md")).alias("path"), F.col("page").alias("text")), root, overwrite=True)
    return changed


def linked_bodies(events: DataFrame, bodies: DataFrame) -> DataFrame:
    """[R8, C14] bodies (project, name, body) with their block of links renewed; bodies that are an
    error message are left alone."""
    fresh = links.sections(events)
    clean = text.strip_marked(F.col("body"))
    failed = F.ltrim("body").rlike("^Error: ")
    both = bodies.join(fresh, ["project", "name"], "left")
    renewed = F.when(F.col("section").isNull(), clean).otherwise(F.concat(F.regexp_replace(clean, r"\s+$", ""), F.lit("\n\n"), "section", F.lit("\n")))
    return both.select("project", "name", F.when(failed, F.col("body")).otherwise(renewed).alias("body"))

