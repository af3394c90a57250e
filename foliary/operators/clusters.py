"""Timelines of projects: islands of activity, status, parties, rendered blocks."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions import text
from foliary.functions.paths import without_md
from foliary.operators.rows import joined

GAP_DAYS = 7


def dated(events: DataFrame) -> DataFrame:
    """Events with a date, with folder ('' is '(root)')."""
    return events.where("event_date IS NOT NULL").withColumn("folder", F.coalesce(F.nullif(F.col("subfolder"), F.lit("")), F.lit("(root)")))


def days(events: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """project, folder, event_date, n_events, island: a new island begins after a gap of more days.

    Islands depend on days alone, so events are counted by day first: a folder's window has a row
    for each of its days, however many events it has."""
    each = dated(events).groupBy("project", "folder", "event_date").agg(F.count("*").alias("n_events"))
    order = Window.partitionBy("project", "folder").orderBy("event_date")
    gap = F.datediff("event_date", F.lag("event_date").over(order)) > gap_days
    return each.withColumn("island", F.sum(F.when(gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def islands(events: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """Dated events with folder and island."""
    return joined(dated(events), days(events, gap_days).drop("n_events"), ["project", "folder", "event_date"])


def clusters(events: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """[W1, W9] project, folder, island, start, end, n_events, n_islands (of the folder)."""
    grouped = days(events, gap_days).groupBy("project", "folder", "island").agg(F.min("event_date").alias("start"), F.max("event_date").alias("end"), F.sum("n_events").alias("n_events"))
    return grouped.withColumn("n_islands", F.count("*").over(Window.partitionBy("project", "folder")))


def status(events: DataFrame, today: datetime.date, active: int = 180, on_hold: int = 730) -> DataFrame:
    """[E2] project, status, timeline_start, timeline_end (of completed ones), n_events."""
    spans = events.groupBy("project").agg(F.min("event_date").alias("timeline_start"), F.max("event_date").alias("latest"), F.count("*").alias("n_events"))
    days = F.datediff(F.lit(today), F.col("latest"))
    kind = F.when(days.isNull() | (days <= active), "active").when(days <= on_hold, "on-hold").otherwise("completed")
    return spans.select("project", kind.alias("status"), "timeline_start", F.when(kind == "completed", F.col("latest")).alias("timeline_end"), "n_events")


def parties(events: DataFrame) -> DataFrame:
    """[E3, U7] project, parties: distinct, in the order in which they first appear."""
    each = events.select("project", "ord", F.posexplode("parties").alias("pos", "party")).where("party <> ''")
    first = each.groupBy("project", "party").agg(F.min(F.struct("ord", "pos")).alias("at"))
    listed = F.sort_array(F.collect_list(F.struct("at", "party")))
    return first.groupBy("project").agg(F.array_join(F.transform(listed, lambda x: x["party"]), ", ").alias("parties"))


def labels(events: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """[F14, S5] Clusters with a label: the longest token that all events share (ties by the
    token), else shared Han characters in the first name's order, else the first name."""
    rows = islands(events, gap_days).withColumn("stem", without_md(F.col("note_filename")))
    own = F.array_distinct(F.concat(text.tokens(F.col("stem")), text.tokens(F.col("summary_hint"))))
    rows = rows.withColumn("tokens", F.filter(own, lambda t: ~t.isin(text.LABEL_STOPS)))
    key = ["project", "folder", "island"]
    # Tokens that as many events have as there are: counted, not intersected in one task's memory.
    # The token '' stands for the event itself, so one pass over the events does.
    each = rows.select(*key, "event_date", F.struct("event_date", "note_filename", "ord").alias("at"), "stem", F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"))
    counts = each.groupBy(*key, "token").agg(F.count("*").alias("n"), F.min("event_date").alias("start"), F.max("event_date").alias("end"), F.min(F.when(F.col("token") == "", F.struct("at", "stem"))).alias("first"))
    counts = counts.withColumn("n_events", F.max("n").over(Window.partitionBy(*key))).where("n = n_events")
    word = F.min(F.when(F.char_length("token") >= 2, F.struct((-F.char_length("token")).alias("l"), F.col("token"))))
    rows = counts.groupBy(*key).agg(
        F.max("n_events").alias("n_events"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("first.stem").alias("first"),
        word["token"].alias("word"), F.collect_set(F.when(F.char_length("token") == 1, F.col("token"))).alias("marks"),
    ).withColumn("n_islands", F.count("*").over(Window.partitionBy("project", "folder")))
    marks = F.array_join(F.array_distinct(F.filter(F.split("first", ""), lambda c: F.array_contains("marks", c))), "")
    stem = F.trim(text.strip_date_prefix(F.col("first")))
    several = F.col("n_events") > 1
    count = F.concat(F.col("n_events").cast("string"), F.lit(" event"), F.when(several, "s").otherwise(""))
    name = F.coalesce("word", F.nullif(marks, F.lit("")), F.nullif(stem, F.lit("")))
    label = F.coalesce(F.concat(name, F.when(several, F.concat(F.lit(" ×"), F.col("n_events").cast("string"))).otherwise("")), count)
    label = F.concat(label, F.when(F.col("n_islands") > 1, F.concat(F.lit(" ("), (F.col("island") + 1).cast("string"), F.lit(")"))).otherwise(""))
    return rows.select(*key, "start", "end", "n_events", text.gantt_escape(label).alias("label"))


def bar() -> Column:
    """The line of a labelled island."""
    return F.concat(F.lit("        "), "label", F.lit(" :"), F.col("start").cast("string"), F.when(F.col("start") == F.col("end"), ", 1d").otherwise(F.concat(F.lit(", "), F.col("end").cast("string"))))


def gantt(events: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """[R3] project, block: folders by their first start, islands by start."""
    rows = labels(events, gap_days)
    bars = rows.groupBy("project", "folder").agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("island", bar().alias("bar")))).alias("bars"))
    lines = F.concat(F.lit("    section "), text.gantt_escape(F.col("folder")), F.lit("\n"), F.array_join(F.transform("bars", lambda b: b["bar"]), "\n"))
    whole = bars.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("start", "folder", lines.alias("lines")))).alias("s"))
    head = F.concat(F.lit("```mermaid\ngantt\n    title "), text.gantt_escape(F.col("project")), F.lit("\n    dateFormat YYYY-MM-DD\n"))
    return whole.select("project", F.concat(head, F.array_join(F.transform("s", lambda x: x["lines"]), "\n"), F.lit("\n```")).alias("block"))


def navigation(events: DataFrame) -> DataFrame:
    """[R2, S2] project, block: events by subfolder, for projects with two or more of them."""
    rows = events.where("subfolder <> ''").withColumn("line", text.timeline_line(F.col("event_date"), F.col("note_filename"), F.col("summary_hint"), F.col("fallback_hint")))
    each = rows.groupBy("project", "subfolder").agg(F.sort_array(F.collect_list(F.struct("event_date", "note_filename", "line"))).alias("l"))
    each = each.select("project", "subfolder", F.concat(F.lit("### "), "subfolder", F.lit("/\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("part"))
    whole = each.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("subfolder", "part"))).alias("p")).where(F.size("p") > 1)
    return whole.select("project", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("block"))
