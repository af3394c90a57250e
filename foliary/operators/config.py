"""Settings of three tiers (template, domain, project), merged for all domains at once."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = ["routing_patterns", "content_overrides", "skip_patterns", "default_tags"]


def merged_list(*tiers: Column) -> Column:
    """[U1] The last tier's entries first, each once."""
    return F.array_distinct(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in reversed(tiers)]))


def merged_list_legacy(*tiers: Column) -> Column:
    """[U2] The last tier's entries first, repeated ones too."""
    return F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in reversed(tiers)])


def merged_scalar(*tiers: Column) -> Column:
    """[U9] The last tier that has one."""
    return F.coalesce(*reversed(tiers))


def merged_map(*tiers: Column) -> Column:
    """[U8] Keys of all tiers; later ones win, whatever the session's map policy is."""

    def over(base: Column, tier: Column) -> Column:
        return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(tier, k)), tier)

    return functools.reduce(over, [F.coalesce(t, F.create_map().cast("map<string,string>")) for t in tiers])


def effective(domains: DataFrame, templates: DataFrame, project: DataFrame, legacy: bool = False) -> DataFrame:
    """[K10] One row per domain (name, template, archive_root, fallback, style, lists) with its template's
    and the project's entries (one row; more fail the job). Styles: template, then global, then domain, then project; the
    legacy order begins with global."""
    t = templates.select(F.col("name").alias("template"), *[F.col(c).alias(f"t_{c}") for c in (*LISTS, "fallback", "style")])
    p = project.select(*[F.col(c).alias(f"p_{c}") for c in (*LISTS, "fallback", "style")], F.col("global_style").alias("g_style"))
    only = F.when(F.count("*") > 1, F.raise_error(F.lit("settings of more than one project"))).otherwise(F.first(F.struct("*")))
    p = p.agg(only.alias("row")).select("row.*")
    rows = domains.join(t, "template", "left").join(F.broadcast(p), F.lit(True), "left")  # one row
    first = (F.col("g_style"), F.col("t_style")) if legacy else (F.col("t_style"), F.col("g_style"))
    merge = merged_list_legacy if legacy else merged_list
    return rows.select(
        "name", "archive_root",
        *[merge(F.col(f"t_{c}"), F.col(c), F.col(f"p_{c}")).alias(c) for c in LISTS],
        F.coalesce(merged_scalar(F.col("t_fallback"), F.nullif("fallback", F.lit("")), F.col("p_fallback")), F.lit("Inbox")).alias("fallback"),
        merged_map(*first, F.col("style"), F.col("p_style")).alias("style"),
    )


def handler_registry(built_in: DataFrame, category_overrides: DataFrame, extra: DataFrame, skips: DataFrame) -> DataFrame:
    """[A42] ext, category: overrides by category, then extra extensions, less skipped ones."""
    rows = built_in.join(category_overrides.select("category", F.col("to").alias("moved")), "category", "left").select("ext", F.coalesce("moved", "category").alias("category"), F.lit(0).alias("layer"))
    rows = rows.unionByName(extra.select("ext", "category", F.lit(1).alias("layer")))
    return rows.groupBy("ext").agg(F.max_by("category", "layer").alias("category")).join(skips.select("ext"), "ext", "left_anti")


def installed_hashes(hashes: Column) -> Column:
    """[K12] Entries that are hashes of 12 digits."""
    return F.map_filter(hashes, lambda _, v: v.rlike("^[0-9a-f]{12}$"))


def version_notice(previous: Column, current: Column) -> Column:
    """[K12] True where a version was seen before and is another one now."""
    return previous.isNotNull() & ~previous.eqNullSafe(current)


def needs_update(entries: DataFrame, prompt: str, hours: int = 24) -> DataFrame:
    """[C20, F56] entries (repo, checked_at, now, disabled) to be checked: not disabled, stale, and the prompt is about it."""
    stale = F.col("checked_at").isNull() | (F.col("now") - F.col("checked_at") > F.expr(f"INTERVAL {hours} HOURS"))
    return entries.where(~F.coalesce("disabled", F.lit(False)) & stale & F.contains(F.lit(prompt.lower()), F.lower("repo")))


def coding_overlay(notes: DataFrame, allowed: list[str]) -> DataFrame:
    """[K7] fm (map) with the overlay's keys, of which only allowed ones may stand; unknown lists the others."""
    return notes.withColumn("unknown", F.array_except(F.map_keys("overlay"), F.array(*map(F.lit, allowed)))).withColumn("fm", merged_map(F.col("fm"), F.map_filter("overlay", lambda k, _: k.isin(allowed))))


def reconcile(notes: DataFrame, archive: DataFrame) -> DataFrame:
    """[K9, R12] note_path, misrouted, unverified, source_missing of notes (subfolder, routed, confidence, source_path)."""
    there = archive.select(F.col("path").alias("source_path"), F.lit(True).alias("there")).distinct()
    rows = notes.join(there, "source_path", "left")
    return rows.select("note_path", (F.col("subfolder") != F.col("routed")).alias("misrouted"), (F.col("confidence") != "high").alias("unverified"), ((F.coalesce("source_path", F.lit("")) != "") & F.col("there").isNull()).alias("source_missing"))
