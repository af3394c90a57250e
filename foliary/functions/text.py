"""Tokens, labels and fragments of notes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that say nothing about a topic.
STOP_TOKENS = ["event", "note", "file", "folder", "meeting", "admin", "sd", "dd", "cd", "ca", "drawing", "drawings", "the", "and", "of", "for", "with", "to", "a", "an"]
LABEL_STOPS = ["md", "txt", "pdf", "docx", "pptx", "xlsx"]
#: One character of these is a token of its own.
HAN = r"一-鿿"
MARKER_START, MARKER_END = "<!-- related-start -->", "<!-- related-end -->"


def strip_date_prefix(text: Column) -> Column:
    """[F12]"""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\d{4}-\d{2}-\d{2}[-\s]*", "")


def tokens(text: Column) -> Column:
    """Distinct topic tokens: Han characters, and other word runs of two or more."""
    found = F.regexp_extract_all(strip_date_prefix(text), F.lit(rf"[{HAN}]|[\p{{L}}\p{{N}}_&&[^{HAN}]]+"), 0)
    found = F.transform(found, F.lower)
    return F.array_distinct(F.filter(found, lambda t: t.rlike(f"^[{HAN}]$") | ((F.char_length(t) >= 2) & ~t.isin(STOP_TOKENS))))


def confidence(text: Column) -> Column:
    """[C4] none, low up to 100 characters, else high."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, "none").when(n <= 100, "low").otherwise("high")


def has_han(text: Column) -> Column:
    """[F24]"""
    return F.coalesce(text.rlike("[㐀-䶿一-鿿]"), F.lit(False))


def chinese_mode(explicit: Column, topic: Column, urls: Column) -> Column:
    """What was asked for, else Han in the topic, else a hint in the URLs."""
    hinted = F.exists(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.lower(u).rlike(r"\.cn(/|:|$)|weixin|zhihu"))
    return F.coalesce(explicit, has_han(topic) | hinted)


def gantt_escape(text: Column) -> Column:
    """Without colons, backticks and quotes; '_' if nothing is left."""
    clean = F.trim(F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(":"), F.lit("-")), F.lit("`"), F.lit("")), F.lit('"'), F.lit("")))
    return F.when(clean == "", "_").otherwise(clean)


def yaml_quote(text: Column) -> Column:
    """[F16] Quoted where a bare scalar would be read as something else."""
    risky = text.rlike(r"[:#\[\]{},&*!|>'\"%@`]|^[\s\-?]|\s$|^$|^(?i:true|false|null|yes|no|on|off|~)$|^[\d.+\-]+$")
    return F.when(risky, F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)


def timeline_line(date: Column, name: Column, hint: Column, fallback: Column) -> Column:
    """[F23]"""
    said = F.coalesce(F.nullif(F.trim(hint), F.lit("")), F.nullif(F.trim(fallback), F.lit("")))
    return F.concat(F.lit("- =="), date.cast("string"), F.lit("== — [["), name, F.lit("]]"), F.coalesce(F.concat(F.lit(" — "), said), F.lit("")))


def fallback_hint(kind: Column, pages: Column, sheets: Column, images: Column, captured: Column, base: Column) -> Column:
    """What kind of event this is, from its file type alone."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    counted = lambda head, n, unit: F.concat(F.lit(head), n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""))
    some = lambda n: F.coalesce(n, F.lit(0)) > 0
    word = F.when(kind == "", "file").otherwise(kind)
    return (
        F.when((kind == "image-folder") & some(images), counted("image folder, ", images, "file"))
        .when(kind == "folder", "folder event")
        .when((kind == "pdf") & some(pages), counted("pdf, ", pages, "page"))
        .when(kind == "pdf", "pdf document")
        .when(kind.isin("docx", "odt", "pages"), F.concat(kind, F.lit(" document")))
        .when(kind.isin("pptx", "key", "odp"), F.concat(kind, F.lit(" presentation")))
        .when(kind.isin("xlsx", "numbers", "ods") & some(sheets), counted("spreadsheet, ", sheets, "sheet"))
        .when(kind.isin("xlsx", "numbers", "ods"), F.concat(kind, F.lit(" spreadsheet")))
        .when(kind.isin("dwg", "dxf", "rvt", "3dm", "skp"), F.concat(kind, F.lit(" cad model")))
        .when(kind.isin("ai", "psd"), F.concat(kind, F.lit(" artwork")))
        .when(kind.isin("jpg", "jpeg", "png", "webp", "gif", "tiff", "heic"), "single image")
        .when(kind.isin("mov", "mp4"), "video, not read")
        .when(kind.isin("zip", "rar", "7z", "tar"), "archive, not read")
        .when(kind.isin("url", "webloc"), "link shortcut")
        .when(kind.isin("eml", "msg"), "email message")
        .when(kind.isin("md", "txt", "rtf"), F.concat(kind, F.lit(" text")))
        .when(F.coalesce(captured, F.lit("")) != "", F.concat(word, F.lit(" captured "), captured))
        .when(F.coalesce(base, F.lit("")) != "", F.concat(word, F.lit(": "), base))
        .otherwise("")
    )


def strip_marked(body: Column) -> Column:
    """Without the block that an earlier run has put between the markers."""
    cut = F.regexp_replace(body, f"(?s){MARKER_START}.*?{MARKER_END}", "")
    return F.when(F.contains(body, F.lit(MARKER_START)), F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("\n"))).otherwise(body)


def abstract(body: Column) -> Column:
    """The abstract callout, else a first sentence of 5 to 35 words, else ''."""
    callout = F.regexp_extract(body, r"(?m)^> \[!abstract\][^\n]*\n((?:>[^\n]*\n?)+)", 1)
    said = F.trim(F.regexp_replace(F.regexp_replace(callout, r"(?m)^>\s?", ""), r"\s+", " "))
    plain = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), F.trim), lambda x: (x != "") & ~x.rlike(r"^(#|>|!\[|\|)"))
    prose = F.regexp_replace(F.coalesce(F.get(plain, F.lit(0)), F.lit("")), r"^[-*] ", "")
    sentence = F.trim(F.get(F.split(prose, r"(?<=[.!?。！？])\s+", 2), F.lit(0)))
    n = F.size(F.split(sentence, r"\s+"))
    return F.when(F.coalesce(said, F.lit("")) != "", said).when(n.between(5, 35), sentence).otherwise("")


def key_order(fence: Column) -> Column:
    """The top-level keys of a frontmatter text, in their order."""
    lines = F.filter(F.split(F.coalesce(fence, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[^#\s\-][^:]*:|^[^#\s\-:]*:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1))), lambda k: k != "")


def with_project(note: Column, name: str) -> Column:
    """A note whose frontmatter names another project; text after the frontmatter stays."""
    head = F.regexp_extract(note, r"(?s)^(---\n.*?\n---\n)", 1)
    line = 'project: "' + name.replace("\\", r"\\").replace("$", r"\$") + '"'
    return F.when(head == "", note).otherwise(F.concat(F.regexp_replace(head, r"(?m)^project:[^\n]*$", line), F.substring(note, F.char_length(head) + 1, F.lit(1 << 30))))


def research_name(topic: Column, day: Column) -> Column:
    """The file name of a research note."""
    return F.concat(day, F.lit(" "), topic_slug(topic), F.lit(".md"))


def source_path_of_body(body: Column) -> Column:
    """[F28]"""
    return F.trim(F.regexp_extract(F.coalesce(body, F.lit("")), r"(?m)^NAS:\s*`?([^`\n]+)`?", 1))


@F.pandas_udf(StringType())
def normalized_stem(names: pd.Series) -> pd.Series:
    """NFKD, ASCII, lower case, hyphens; 'image' if nothing is left. Spark has no normaliser."""
    plain = names.fillna("").map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower())
    slug = plain.str.replace(r"[^a-z0-9]+", "-", regex=True).str.strip("-")
    return slug.where(slug != "", "image")


def topic_slug(topic: Column, limit: int = 60) -> Column:
    """A normalised topic of at most `limit` characters, cut between words where it can be."""
    slug = normalized_stem(topic)
    head = F.left(slug, F.lit(limit))
    whole = F.regexp_replace(head, "-[^-]*$", "")
    return F.when(F.char_length(slug) <= limit, slug).when(F.substring(slug, limit + 1, 1) == "-", head).otherwise(F.regexp_replace(whole, "-+$", ""))
