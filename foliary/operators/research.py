"""Sources of a research note."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions import urls


def choose(sources: DataFrame, most: int = 10, share: float = 0.3, trusted: list[str] | None = None, tiers: dict[int, list[str]] | None = None) -> DataFrame:
    """[U10] url, domain, tier, ord: tier 4 dropped, one per URL, one per registered domain, at
    most `most` by tier and order, of which tier 3 may be `share` (of all kept, rounded down)."""
    rows = sources.select("url", "ord", urls.registered_domain(F.col("url")).alias("domain"), urls.tier(F.col("url"), trusted, tiers).alias("tier")).where("tier < 4")
    one = rows.groupBy("domain").agg(F.min_by(F.struct("url", "tier", "ord"), F.struct("tier", "ord")).alias("s")).select("domain", "s.*")
    kept = one.orderBy("tier", "ord").limit(most)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))  # at most `most` rows
    third = F.row_number().over(Window.partitionBy("tier").orderBy("ord"))
    kept = kept.withColumn("n", n).withColumn("k", third)
    return kept.where((F.col("tier") < 3) | (F.col("k") <= F.floor(F.col("n") * share))).select("url", "domain", "tier", "ord")


def footnotes(sources: DataFrame) -> DataFrame:
    """[W10] sources (report, url, tier, ord) with their footnote number: by tier, then order."""
    return sources.withColumn("footnote", F.row_number().over(Window.partitionBy("report").orderBy("tier", "ord")))


def tier_counts(sources: DataFrame) -> DataFrame:
    """[E8] report, tier1 .. tier4; unknown tiers are not counted."""
    return sources.groupBy("report").agg(*[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in (1, 2, 3, 4)])


def report(sources: DataFrame) -> DataFrame:
    """[R10] report, block: counts and numbered sources."""
    numbered = footnotes(sources)
    line = F.concat(F.lit("[^"), F.col("footnote").cast("string"), F.lit("]: "), "url", F.lit(" (tier "), F.col("tier").cast("string"), F.lit(")"))
    lines = numbered.groupBy("report").agg(F.sort_array(F.collect_list(F.struct("footnote", line.alias("line")))).alias("l"))
    said = tier_counts(sources).select("report", F.concat_ws(", ", *[F.concat(F.lit(f"tier {t}: "), F.col(f"tier{t}").cast("string")) for t in (1, 2, 3, 4)]).alias("said"))
    return lines.join(said, "report").select("report", F.concat("said", F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("block"))


def image_urls(notes: DataFrame, most: int = 10) -> DataFrame:
    """[A25] note, url, k: the first distinct image URLs of each Markdown body."""
    found = notes.select("note", F.posexplode(F.regexp_extract_all("body", F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), 1)).alias("pos", "url"))
    first = found.groupBy("note", "url").agg(F.min("pos").alias("pos"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("note").orderBy("pos"))).where(F.col("k") <= most).select("note", "url", "k")
