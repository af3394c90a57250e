"""Scores of pairs of notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.dates import long_proximity, short_proximity
from foliary.functions.paths import shared_leading

# Fixed values.
METADATA_ONLY = ["dwg", "3dm", "rvt", "skp", "rhl", "fbx", "mov", "mp4"]
READABLE = ["folder", "image-folder", "pdf", "docx", "pptx", "xlsx", "jpg", "jpeg", "png", "psd", "ai", "dxf", "txt", "md"]
LEAST_RELATED = 4.0


def is_metadata_only(kind: Column) -> Column:
    """[C8]"""
    return F.coalesce(F.lower(kind).isin(METADATA_ONLY), F.lit(False))


def is_readable(kind: Column) -> Column:
    """[C8]"""
    return F.coalesce(F.lower(kind).isin(READABLE), F.lit(False))


def pair_score(shared_tokens: Column, same_subfolder: Column, shared_parties: Column, date_a: Column, date_b: Column) -> Column:
    """5 a shared token (three at most), 3 for the subfolder, 2 a shared party (three at most), and the dates."""
    three = lambda n: F.least(n, F.lit(3))
    return (5.0 * three(shared_tokens) + F.when(same_subfolder, 3.0).otherwise(0.0) + 2.0 * three(shared_parties) + long_proximity(date_a, date_b)).cast("double")


def relevance(project_a: Column, project_b: Column, date_a: Column, date_b: Column, kind: Column, path_a: Column, path_b: Column) -> Column:
    """3 for the project, the dates, and 1 for a shared path of metadata-only files."""
    bonus = F.lower(kind).isin(METADATA_ONLY) & (F.coalesce(path_a, F.lit("")) != "") & (F.coalesce(path_b, F.lit("")) != "") & (shared_leading(path_a, path_b) > 0)
    return (F.when(project_a.eqNullSafe(project_b), 3.0).otherwise(0.0) + short_proximity(date_a, date_b) + F.when(bonus, 1.0).otherwise(0.0)).cast("double")


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """[F62]"""
    return shared / (a + b - shared).cast("double")


def sha_prefix(content: Column, n: int = 16) -> Column:
    """[F63]"""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, n)


def file_fingerprint(name: Column, size: Column, mtime: Column) -> Column:
    """Of a file: name, size and time, so a renamed file has another one."""
    return sha_prefix(F.concat_ws("\t", name, size.cast("string"), mtime.cast("string")))
