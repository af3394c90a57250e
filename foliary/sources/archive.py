"""Archive listings and the text tables beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions import frontmatter
from foliary.functions.paths import any_segment_matches


def listing(spark: SparkSession, root: str, skip: list[str] = (), content: bool = False) -> DataFrame:
    """[A1] path, size, mtime (seconds) of all files below a root; skipped segments are dropped
    before any content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = df.where(~any_segment_matches(F.col("path"), list(skip)))
    out = [F.col("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime")]
    return df.select(*out, *(["content"] if content else []))


def numbered_lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """file, ord, line of text files, whatever their size: ord is a line's place in its file, or in all files in
    the order of their paths.

    Files are read in splits. A first pass counts the lines of each split, a scan over these few rows gives
    how many come before it, and a line's number within its split is added. Both passes see one listing of
    the files and the same splits, so a split's first id is the same in both."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = Window.orderBy("file", "start") if across else Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each split
    placed = splits.select("file", "start", (before - F.col("first")).alias("shift"))
    return rows.join(placed, ["file", "start"]).select("file", (F.col("id") + F.col("shift")).alias("ord"), "line")


def tab_rows(spark: SparkSession, path: str, names: list[str], comment: str | None = None, more: bool = False, across: bool = False) -> tuple[DataFrame, DataFrame]:
    """[A12, A23] (rows with as many fields as names, rejected lines: file, ord, line). ord is the line's place in
    its file, or `across` all files. With `more`, lines may have further fields, which are left out."""
    whole = numbered_lines(spark, path, across).where(F.trim("line") != "")
    whole = whole.where(~F.startswith("line", F.lit(comment))) if comment else whole
    parts = F.split("line", "\t", -1)
    good = F.size(parts) >= len(names) if more else F.size(parts) == len(names)
    return whole.where(good).select(*[parts[k].alias(n) for k, n in enumerate(names)], F.col("ord").cast("long")), whole.where(~good).select("file", "ord", "line")


def notes(spark: SparkSession, root: str) -> DataFrame:
    """[A16] note_path, fence (the text between the first two --- lines), body; frontmatter.parsed reads the fence."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.input_file_name().alias("note_path"), "value")
    return df.select("note_path", F.coalesce(F.regexp_replace(frontmatter.fence_of(F.col("value")), r"\r?\n\z", ""), F.lit("")).alias("fence"), frontmatter.body_of(F.col("value")).alias("body"))


def page_fields(pages: DataFrame) -> DataFrame:
    """[A21, A22, C13] page_id, title, text, stub: HTML without scripts and tags."""
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?s)<[^>]*>", " "), r"\s+", " "))
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", title.alias("title"), plain.alias("text"), (F.char_length(plain) < 500).alias("stub"))


#: Where a page says a property, in order: names of its meta tags.
META = {
    "author": ["author", "article:author", "dc.creator"],
    "published": ["article:published_time", "date", "pubdate", "dc.date"],
    "description": ["description", "og:description"],
    "site": ["og:site_name", "application-name"],
    "image": ["og:image"],
    "keywords": ["keywords"],
}


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag's text, quoted or not; null if it has none."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    bare = F.regexp_replace(F.regexp_replace(value, rf"(?is)^[\s\"'/]{name}\s*=\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.when(value != "", bare)


def page_property(html: Column, name: str) -> Column:
    """[A22] One value that a page says of itself, trimmed; null if it doesn't, or says nothing. name: title,
    language, charset, one of META, or the name of a meta tag."""
    if name == "title":
        found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    elif name == "language":
        found = attribute(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang")
    else:
        tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), 0)
        if name == "charset":
            found = F.get(F.filter(F.transform(tags, lambda t: attribute(t, "charset")), lambda v: v.isNotNull()), F.lit(0))
        else:
            said = lambda t: F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"), F.lit("")))

            def first_of(wanted: str) -> Column:
                named = F.filter(tags, lambda t: said(t) == wanted)
                return F.get(F.filter(F.transform(named, lambda t: F.nullif(F.trim(attribute(t, "content")), F.lit(""))), lambda v: v.isNotNull()), F.lit(0))

            first = [first_of(n) for n in META.get(name, [name.lower()])]
            found = F.coalesce(*first)
    return F.nullif(F.regexp_replace(found, r"^\s+|\s+$", ""), F.lit(""))
