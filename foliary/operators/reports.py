"""Scan reports and logs as text, and the tallies that stand in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.operators.rows import counters, newest


def first_of(rows: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    """[S7, S8] key, listed (the first n values by ord), more (how many were left out)."""
    order = Window.partitionBy(key).orderBy("ord")
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    few = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", value.alias("v")))).alias("l"))
    return few.join(sizes, key).select(key, F.transform("l", lambda x: x["v"]).alias("listed"), F.greatest(F.col("size") - n, F.lit(0)).alias("more"))


def _part(title: str, lines: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n\n"), F.array_join(lines, "\n"))


def scan_reports(reports: DataFrame, counts: DataFrame, notes: DataFrame, warnings: DataFrame, shown: int = 50) -> DataFrame:
    """[R18, B7] report, file_name, body of reports (report, kind, started, finished), with their counts
    (report, ord, name, value), the first notes written (report, ord, path) and all warnings (report, ord, text)."""
    listed = lambda rows, line: rows.groupBy("report").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("v")))), lambda x: x["v"]).alias("l"))
    tallies = listed(counts, F.concat(F.lit("- **"), "name", F.lit(":** "), F.col("value").cast("string"))).withColumnRenamed("l", "counts")
    warned = listed(warnings, F.concat(F.lit("- "), "text")).withColumnRenamed("l", "warned")
    few = first_of(notes, "report", F.concat(F.lit("- `"), "path", F.lit("`")), shown)
    rest = F.when(F.col("more") > 0, F.array(F.concat(F.lit("- …and "), F.col("more").cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    few = few.select("report", F.concat("listed", rest).alias("written"))
    rows = reports.join(tallies, "report", "left").join(few, "report", "left").join(warned, "report", "left")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    head = F.concat(F.lit("# "), "kind", F.lit(" report\n\n- **Scan type:** "), "kind", F.lit("\n- **Started:** "), stamp("started"), F.lit("\n- **Finished:** "), stamp("finished"))
    body = F.concat(F.concat_ws("\n\n", head, _part("Counts", F.col("counts")), _part("Notes written", F.col("written")), _part("Warnings", F.col("warned"))), F.lit("\n"))
    return rows.select("report", F.concat(F.date_format("finished", "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), "kind", F.lit(".md")).alias("file_name"), body.alias("body"))


def scan_report_parts(reports: DataFrame, counts: DataFrame, notes: DataFrame, warnings: DataFrame, shown: int = 50) -> DataFrame:
    """[R18, B7] report, path, part, text: the reports of scan_reports in pieces, a line each, for the file sink; so a
    report may have any number of warnings."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    name = F.concat(F.date_format("finished", "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), "kind", F.lit(".md")).alias("path")
    head = F.concat(F.lit("# "), "kind", F.lit(" report\n\n- **Scan type:** "), "kind", F.lit("\n- **Started:** "), stamp("started"), F.lit("\n- **Finished:** "), stamp("finished"))
    part = lambda section, at: F.struct(F.lit(section).alias("section"), at.cast("long").alias("at"), F.lit("").alias("tie")).alias("part")
    own = reports.select("report", name)
    rows = reports.select("report", name, part(0, F.lit(0)), head.alias("text"))

    def section(k: int, title: str, lines: DataFrame) -> DataFrame:
        """lines: report, at, line."""
        found = lines.join(own, "report")
        titles = found.select("report", "path").distinct().select("report", "path", part(k, F.lit(0)), F.lit(f"\n\n## {title}\n").alias("text"))
        each = F.struct(F.lit(k + 1).alias("section"), F.col("at").cast("long").alias("at"), F.col("line").alias("tie")).alias("part")
        return titles.union(found.select("report", "path", each, F.concat(F.lit("\n"), "line").alias("text")))

    few = notes.withColumn("at", F.row_number().over(Window.partitionBy("report").orderBy("ord"))).where(F.col("at") <= shown).select("report", "at", F.concat(F.lit("- `"), "path", F.lit("`")).alias("line"))
    more = notes.groupBy("report").agg(F.count("*").alias("n")).where(F.col("n") > shown).select("report", F.lit(shown + 1).alias("at"), F.concat(F.lit("- …and "), (F.col("n") - shown).cast("string"), F.lit(" more")).alias("line"))
    rows = rows.union(section(1, "Counts", counts.select("report", F.col("ord").alias("at"), F.concat(F.lit("- **"), "name", F.lit(":** "), F.col("value").cast("string")).alias("line"))))
    rows = rows.union(section(3, "Notes written", few.union(more)))
    rows = rows.union(section(5, "Warnings", warnings.select("report", F.col("ord").alias("at"), F.concat(F.lit("- "), "text").alias("line"))))
    return rows.union(reports.select("report", name, part(9, F.lit(0)), F.lit("\n").alias("text")))


def log_text(entries: DataFrame, most: int = 200) -> DataFrame:
    """[R19] One row, body: counters by type and entries (ord, timestamp, type, summary, details), the
    newest first. An order of all entries is cut off at `most`, so the body is bounded."""
    rows = newest(entries, most)
    line = F.concat(F.lit("- **"), "timestamp", F.lit("** · `"), "type", F.lit("` · "), "summary", F.coalesce(F.concat(F.lit("\n  - details: `"), "details", F.lit("`")), F.lit("")))
    said = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("ord")).alias("o"), line.alias("v")))), lambda x: x["v"]).alias("entries"))
    kinds = counters(rows, "type").agg(F.transform(F.sort_array(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(F.lit("- "), x["type"], F.lit(": "), x["n"].cast("string"))).alias("counts"))
    return said.crossJoin(kinds).select(F.concat_ws("\n\n", _part("Counters", F.col("counts")), _part("Entries", F.col("entries"))).alias("body"))  # one row each


def check_counts(findings: DataFrame, checks: list[str]) -> DataFrame:
    """[E11] check, n of audit rows (check, note, detail), with 0 for a check that found nothing."""
    spark = findings.sparkSession
    named = spark.createDataFrame([(c,) for c in checks], "check string")
    return named.join(findings.groupBy("check").agg(F.count("*").alias("n")), "check", "left").select("check", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reconcile_counts(flags: DataFrame) -> DataFrame:
    """[E11, R12] project -> the seven tallies of notes flagged needs_fix, misrouted, source_missing,
    source_unknown, unverified (booleans); valid are those without any of the first three."""
    sound = ~(F.col("needs_fix") | F.col("misrouted") | F.col("source_missing"))
    tally = lambda c: F.count_if(c)
    return flags.groupBy("project").agg(
        F.count("*").alias("notes"), tally(sound).alias("valid"), *[tally(F.col(c)).alias(c) for c in ("needs_fix", "misrouted", "source_missing", "source_unknown", "unverified")]
    )
