"""Template files and small summaries of tools and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions.paths import basename
from foliary.functions.scoring import sha_prefix


def bank(files: DataFrame) -> DataFrame:
    """[A24] files (path, content) that aren't hidden, with category, stem and a hash of 12 digits."""
    parts, name = F.split("path", "/"), basename(F.col("path"))
    rows = files.where(~F.startswith(name, F.lit(".")))
    return rows.select("path", F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("(top-level)").alias("category"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"), sha_prefix(F.col("content"), 12).alias("hash"))


def to_install(templates: DataFrame, installed: DataFrame) -> DataFrame:
    """[B13] Templates that are new or changed: those that aren't installed (path, hash) as they are."""
    return templates.join(installed.select("path", "hash"), ["path", "hash"], "left_anti")


def family_index(templates: DataFrame) -> DataFrame:
    """[E16, B13] category, block: a heading and a link to each stem, by path."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("path", "stem"))), lambda x: F.concat(F.lit("- [["), x["stem"], F.lit("]]")))
    return templates.groupBy("category").agg(F.concat(F.lit("## "), F.replace("category", F.lit("_"), F.lit(" ")), F.lit("\n\n"), F.array_join(listed, "\n")).alias("block"))


def last_release(packages: DataFrame) -> DataFrame:
    """[E14] package, last_release: the day of the latest upload in releases (an array of arrays of
    times); '' without any."""
    return packages.select("package", F.left(F.coalesce(F.array_max(F.filter(F.flatten("releases"), lambda x: x.isNotNull())), F.lit("")), F.lit(10)).alias("last_release"))


def missing_tools(needs: DataFrame, present: DataFrame) -> DataFrame:
    """[E15] tool, categories (sorted, distinct) of needs (tool, category, install) that can be installed
    and aren't present (tool)."""
    rows = needs.where("install IS NOT NULL").join(present.select("tool"), "tool", "left_anti")
    return rows.groupBy("tool").agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))
