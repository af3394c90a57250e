"""Where files belong: domains by prefix, subfolders by rules, folder structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary import model
from foliary.functions.paths import any_segment_matches, category, extension, has_prefix


def domain_of(files: DataFrame, domains: list[tuple[str, str]], boundary: bool = True) -> DataFrame:
    """[D4j] files with domain: the longest root that is a prefix, ties by the list's order; a
    single domain always wins; null is ambiguous. The list is configuration, so it is a CASE."""
    if len(domains) == 1:
        return files.withColumn("domain", F.lit(domains[0][0]))
    ordered = sorted(enumerate(domains), key=lambda d: (-len(d[1][1]), d[0]))
    out = F.lit(None).cast("string")
    for _, (name, root) in reversed(ordered):
        out = F.when(F.lit(root != "") & has_prefix(F.col("path"), F.lit(root), boundary), name).otherwise(out)
    return files.withColumn("domain", out)


def first_domain(files: DataFrame, domains: list[tuple[str, str]]) -> DataFrame:
    """[D5j] files with domain: the first root in the list that is a prefix."""
    out = F.lit(None).cast("string")
    for name, root in reversed(domains):
        out = F.when(F.startswith("path", F.lit(root)), name).otherwise(out)
    return files.withColumn("domain", out)


def route(files: DataFrame, rules: list[tuple[str, str]], overrides: list[tuple[str, str]] = (), fallback: str = "Admin", mode: str = "pattern") -> DataFrame:
    """[D14j] files (name, text) with subfolder: the first rule whose words the name contains,
    then the first override whose words the text contains. mode 'fallback' gives the fallback."""
    out = F.lit(fallback)
    if mode == "pattern":
        for match, subfolder in reversed(list(rules)):
            out = F.when(F.contains(F.lower("name"), F.lit(match.lower())), subfolder).otherwise(out)
        for when, subfolder in reversed(list(overrides)):
            out = F.when(F.contains(F.lower("text"), F.lit(when.lower())), subfolder).otherwise(out)
    return files.withColumn("subfolder", out)


def keep_segments(files: DataFrame, patterns: list[str]) -> DataFrame:
    """[A1, A2] Files none of whose path segments matches a pattern."""
    return files.where(~any_segment_matches(F.col("path"), patterns))


def structure(files: DataFrame) -> DataFrame:
    """[A9, A10, A11, E7] name, child_count (all below), has_files_directly, has_subfolders, scannable."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    scannable = [e for c, own in model.CATEGORIES.items() if c not in model.SKIPPED_CATEGORIES for e in own]
    rows = files.select(F.get(parts, F.lit(0)).alias("name"), F.size(parts).alias("depth"), extension(F.col("path")).alias("ext")).where("depth > 1")
    return rows.groupBy("name").agg(
        F.count("*").alias("child_count"), F.bool_or(F.col("depth") == 2).alias("has_files_directly"), F.bool_or(F.col("depth") > 2).alias("has_subfolders"), F.bool_or(F.col("ext").isin(scannable) & (F.col("depth") <= 3)).alias("scannable")
    )


def new_subfolders(folders: DataFrame, rules: list[str], skips: list[str]) -> DataFrame:
    """[C9, C10, R23] Folders that no rule names and no pattern skips, with three files or a scannable one."""
    routed = F.lit(False)
    for match in rules:
        routed = routed | F.contains(F.lower("name"), F.lit(match.lower()))
    return folders.where(~routed & ~any_segment_matches(F.col("name"), skips) & ((F.col("child_count") >= 3) | F.col("scannable")))


def unknown_counts(folders: DataFrame) -> DataFrame:
    """[E17] domain, unknown_subfolders of new subfolders (domain, name)."""
    return folders.groupBy("domain").agg(F.count("*").alias("unknown_subfolders"))


def handler(files: DataFrame) -> DataFrame:
    """[C1, C3, C6] files with category, skip_reason (unknown type, or a category that isn't read)."""
    own = category(F.col("path"))
    reason = F.when(own.isNull(), "unknown").when(own.isin(model.SKIPPED_CATEGORIES), own)
    return files.withColumn("category", own).withColumn("skip_reason", reason)
