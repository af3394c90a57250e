"""Generated pages that exist already: what a user wrote in them stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions import frontmatter
from foliary.functions.paths import basename, project_of_note, without_md
from foliary.operators import clusters

START, END = "<!-- auto-start -->", "<!-- auto-end -->"
# The headings whose text is kept by name, and those that are generated anew.
KEPT = {"Parties": "parties", "Budget": "budget", "Key Decisions": "key_decisions", "Open Items": "open_items", "Related Projects": "related_projects"}
GENERATED = ["Status", "Timeline", "Timeline (all events)", "Subfolders", "Substructures"]

stripped = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")


def _sections(body: Column) -> Column:
    """name, content of every part that begins with a second-level heading."""
    parts = F.slice(F.split(body, r"(?m)^## (?=.)"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(stripped(F.substring_index(p, "\n", 1)).alias("name"), stripped(F.regexp_replace(p, r"^[^\n]*", "")).alias("content")))


def existing(pages: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """[A17] pages (project, page) with what they hold: frontmatter (map), overview, the kept sections,
    user_sections (all others, as they are), marker_head and marker_tail (around the generated part).

    A small file of many pages is few tasks but much work, so pages are dealt to all cores first. The entries of
    a fence are a column, as an expression that stands several times may be computed as often."""
    whole = F.coalesce("page", F.lit(""))
    fence, body = F.coalesce(frontmatter.fence_of(whole), F.lit("")), frontmatter.body_of(whole)
    around = rf"(?s)^(.*?)\Q{start}\E.*\Q{end}\E(.*)$"
    raw = F.regexp_extract("body", r"> \[!abstract\] Overview\n((?:>.*\n?)*)", 1)
    last = lambda name: F.coalesce(F.try_element_at(F.filter("sections", lambda s: s["name"] == name), F.lit(-1))["content"], F.lit(""))
    own = F.filter("sections", lambda s: ~s["name"].isin([*KEPT, *GENERATED]))
    rows = pages.select("project", "page").repartition("project", "page").select("project", fence.alias("fence"), body.alias("body"))
    rows = rows.withColumn("sections", _sections(F.col("body"))).withColumn("entries", frontmatter.parsed(F.col("fence")))
    return rows.select(
        "project",
        frontmatter.by_key(F.col("entries"), "value").alias("frontmatter"),
        stripped(F.regexp_replace(raw, r"(?m)^> ?", "")).alias("overview"),
        *[last(name).alias(column) for name, column in KEPT.items()],
        F.array_join(F.transform(own, lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n"), s["content"])), "\n\n").alias("user_sections"),
        F.regexp_replace(F.regexp_extract("body", around, 1), r"\s+$", "").alias("marker_head"),
        F.regexp_replace(F.regexp_extract("body", around, 2), r"^\s+", "").alias("marker_tail"),
        F.col("body").rlike(around).alias("has_markers"),
    )


def regenerated(generated: DataFrame, old: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """[R6] generated (project, page) put into the existing pages: between the markers where there are
    any, else before the kept sections and the user's own."""
    kept = existing(old, start, end)
    marked = F.concat(F.lit(start + "\n"), "page", F.lit("\n" + end))
    said = [F.when(F.col(c) != "", F.concat(F.lit(f"## {name}\n\n"), F.col(c))) for name, c in KEPT.items()]
    overview = F.when(F.col("overview") != "", F.concat(F.lit("> [!abstract] Overview\n> "), F.replace("overview", F.lit("\n"), F.lit("\n> "))))
    plain = F.concat_ws("\n\n", overview, marked, *said, F.nullif("user_sections", F.lit("")))
    within = F.concat_ws("\n\n", F.nullif("marker_head", F.lit("")), marked, F.nullif("marker_tail", F.lit("")))
    rows = generated.join(kept, "project", "left")
    return rows.select("project", F.when(F.col("has_markers").isNull(), marked).when(F.col("has_markers"), within).otherwise(plain).alias("page"))


def events_of_index(index: DataFrame) -> DataFrame:
    """[R16] The events that an index's notes stand for: their project, date, subfolder and name."""
    parts, name = F.split("note_path", "/"), basename(F.col("note_path"))
    rows = index.where("note_path <> ''").groupBy("note_path").agg(F.max("ord").alias("ord"))
    return rows.select(
        project_of_note(F.col("note_path")).alias("project"), F.when(F.size(parts) > 3, F.get(parts, F.lit(2))).otherwise("").alias("subfolder"),
        F.try_to_date(F.regexp_extract(name, r"^\d{4}-\d{2}-\d{2}", 0)).alias("event_date"), without_md(name).alias("note_filename"), "ord",
        F.array().cast("array<string>").alias("parties"), F.lit("").alias("summary_hint"), F.lit("").alias("fallback_hint"),
    )


def compose_tasks(events: DataFrame, old: DataFrame) -> DataFrame:
    """[R5] project, notes (to read, in order of time), subfolders, block (the rendered timeline), preserved
    (what the writer is to leave as it is, by heading)."""
    order = F.sort_array(F.collect_list(F.struct("event_date", "note_filename")))
    rows = events.groupBy("project").agg(F.transform(order, lambda x: x["note_filename"]).alias("notes"), F.array_sort(F.collect_set(F.nullif("subfolder", F.lit("")))).alias("subfolders"))
    heads = F.map_filter(F.create_map(*[x for name, c in KEPT.items() for x in (F.lit(name), F.col(c))]), lambda _, v: v != "")
    return rows.join(clusters.gantt(events), "project", "left").join(existing(old).select("project", heads.alias("preserved")), "project", "left")


def table_view(notes: DataFrame) -> DataFrame:
    """[R9] The rows of every project's table: its notes by name, without its own page."""
    return notes.where("coalesce(note_type, '') <> 'project-index'").select("project", basename(F.col("note_path")).alias("file"), "event_date", "content_confidence", "scan_type")
