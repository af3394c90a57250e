"""Paths of archives and notes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary import model


def glob_regex(pattern: str) -> str:
    """A whole-string Java expression for a shell pattern (*, ?, [..], [!..])."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = pattern[k + 1 : end]
            inner = "^" + inner[1:] if inner.startswith("!") else inner
            out.append("[" + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            k = end
        else:
            out.append(c if c.isalnum() or c in "_ " else "\\" + c)
        k += 1
    return "(?s)^" + "".join(out) + "$"


def any_segment_matches(path: Column, patterns: list[str]) -> Column:
    """[A2] True if some segment of the path matches some pattern."""
    if not patterns:
        return F.lit(False)
    either = "|".join(f"(?:{glob_regex(p)[5:-1]})" for p in patterns)
    return F.exists(F.split(path, "/"), lambda s: s.rlike(f"(?s)^(?:{either})$"))


def extension(path: Column) -> Column:
    """The last extension in lower case, '' if none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def project_of_note(path: Column, layout: str = "domain") -> Column:
    """layout 'domain': the second of three or more components, else the first;
    layout 'legacy': always the first."""
    first = F.substring_index(path, "/", 1)
    if layout == "legacy":
        return first
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(first)


def archive_parent(path: Column, project: Column) -> Column:
    """What stands before the first component equal to the project, else the grandparent."""
    parts = F.split(path, "/")
    at = F.array_position(parts, project)
    head = F.array_join(F.slice(parts, 1, F.greatest(at - 1, F.lit(0)).cast("int")), "/")
    grand = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    rooted = F.startswith(path, F.lit("/"))
    either = F.when(at > 0, head).otherwise(grand)
    return F.when(either != "", either).when(rooted, F.lit("/")).otherwise(F.lit("."))


def join_path(*parts: Column) -> Column:
    """Non-empty parts without slashes at their ends, joined by one slash."""
    clean = [F.nullif(F.regexp_replace(F.trim(p), "^/+|/+$", ""), F.lit("")) for p in parts]
    return F.concat_ws("/", *clean)


def without_md(name: Column) -> Column:
    """One '.md' less at the end."""
    return F.regexp_replace(name, r"\.md$", "")


def wikilink(name: Column) -> Column:
    return F.concat(F.lit("[["), without_md(name), F.lit("]]"))


def attachments_root(path: Column) -> Column:
    """The parent of the event's folder, or the folder itself if it is the only segment."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)


def batch_slug(stem: Column) -> Column:
    """[F8] Lower case, runs of other characters to hyphens, 30 characters, no hyphens at the ends."""
    return F.regexp_replace(F.left(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), F.lit(30)), "^-+|-+$", "")


def shared_leading(a: Column, b: Column) -> Column:
    """Common leading segments less one, at least 0."""
    cut = lambda p: F.filter(F.split(p, "/"), lambda s: s != "")
    same = F.zip_with(cut(a), cut(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    run = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))
    return F.greatest(run["n"] - 1, F.lit(0))


def has_prefix(path: Column, prefix: Column, boundary: bool = True) -> Column:
    """[D6] boundary: only whole components count; else any leading characters."""
    loose = F.startswith(path, prefix)
    if not boundary:
        return loose
    return (path == prefix) | F.startswith(path, F.concat(F.regexp_replace(prefix, "/$", ""), F.lit("/")))


def rewrite_prefix(path: Column, old: str, new: str, boundary: bool = True) -> Column:
    """[B4] The path under its new prefix, or as it is."""
    return F.when(has_prefix(path, F.lit(old), boundary), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def category(path: Column) -> Column:
    """[A30] The handler category of a file's extension, null if unknown."""
    return literal_map({e: c for c, own in model.CATEGORIES.items() for e in own})[extension(path)]


def file_type(path: Column) -> Column:
    """The note schema's type: none is a folder, unknown ones are 'other'."""
    ext = extension(path)
    known = [t for t in model.FILE_TYPES if t not in ("folder", "image-folder", "other")]
    mapped = F.coalesce(literal_map(model.TYPE_OF_EXTENSION)[ext], ext)
    return F.when(ext == "", "folder").when(mapped.isin(known), mapped).otherwise("other")
