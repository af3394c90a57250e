"""Event dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_prefix(name: Column) -> Column:
    """YYYY-MM-DD or YYMMDD at the start, followed by white space, one of -_. or the end.
    Two-digit years below 70 are 20YY. An invalid ISO date gives null without trying the other."""
    iso = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})(?:[\s\-_.]|$)", 1)
    short = F.regexp_extract(name, r"^(\d{6})(?:[\s\-_.]|$)", 1)
    century = F.when(F.substring(short, 1, 2) < "70", "20").otherwise("19")
    spelled = F.concat_ws("-", F.concat(century, F.substring(short, 1, 2)), F.substring(short, 3, 2), F.substring(short, 5, 2))
    found = F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).when(short != "", F.try_to_date(spelled, "yyyy-MM-dd"))
    return F.when(F.year(found) >= 1, found)


def event_date(name: Column, parent: Column, mtime: Column) -> Column:
    """struct<event_date, source>: the file's prefix, else the parent's, else mtime in UTC."""
    own, above = date_prefix(name), date_prefix(parent)
    fallback = F.to_date(F.timestamp_seconds(mtime))
    source = F.when(own.isNotNull(), "filename-prefix").when(above.isNotNull(), "parent-folder-prefix").otherwise("mtime")
    return F.struct(F.coalesce(own, above, fallback).alias("event_date"), source.alias("source"))


def is_iso_shape(text: Column) -> Column:
    """Ten characters of digits and hyphens; the date needn't exist."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def short_proximity(a: Column, b: Column) -> Column:
    """10 on the same day, 10 less the days up to three, else 0."""
    days = F.abs(F.datediff(a, b))
    return F.coalesce(F.when(days <= 3, 10.0 - days).otherwise(0.0), F.lit(0.0)).cast("double")


def long_proximity(a: Column, b: Column) -> Column:
    """Falls from 4 on the same day to 0 after 14 days."""
    days = F.abs(F.datediff(a, b))
    return F.coalesce(F.when(days <= 14, 4.0 * (1.0 - days.cast("double") / 14.0)).otherwise(0.0), F.lit(0.0)).cast("double")


def is_stale(checked_at: Column, now: Column, hours: int) -> Column:
    """Never checked, or longer ago than so many hours."""
    return checked_at.isNull() | (now - checked_at > F.expr(f"INTERVAL {hours} HOURS"))
