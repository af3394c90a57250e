"""Note schema: violations, upgrade, and what an upgrade changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary import model
from foliary.functions import frontmatter
from foliary.functions.dates import date_prefix, is_iso_shape
from foliary.functions.paths import file_type
from foliary.functions.text import source_path_of_body


def field(name: str) -> Column:
    return F.try_element_at("fm", F.lit(name))


def items(name: str) -> Column:
    """Number of elements of a list field, which is JSON in the raw map; 0 if absent."""
    return F.coalesce(F.json_array_length(field(name)), F.lit(0))


def is_integer(name: str) -> Column:
    return F.coalesce(field(name).rlike(r"^-?\d+$"), F.lit(False))


def invariants() -> list[tuple[str, Column]]:
    """[K3] (code, true where violated), in order."""
    sources, said = items("sources_read"), F.coalesce(field("content_confidence"), F.lit(""))
    embedded = F.coalesce(F.when(is_integer("images_embedded"), field("images_embedded").try_cast("int")), F.lit(0))
    return [
        ("sources-without-confidence", (sources > 0) & ~said.isin("high", "low")),
        ("confidence-without-sources", (sources == 0) & (said != "metadata-only")),
        ("bytes-without-sources", (sources == 0) & (F.coalesce(field("read_bytes"), F.lit("0")) != "0")),
        ("domain-path", F.coalesce(field("domain").rlike(r"[/\\]|^$"), F.lit(False))),
        ("images-without-attachments", (embedded > 0) & (items("attachments") != embedded)),
        ("captions-not-aligned", (items("image_captions") > 0) & (items("image_captions") != items("attachments"))),
    ]


def kind_is(name: str, *kinds: str) -> Column:
    return F.coalesce(F.try_element_at("kinds", F.lit(name)).isin(*kinds), F.lit(False))


def there(name: str, typed: bool) -> Column:
    """Whether a note has the field; a field without a value is there if kinds tell."""
    return F.map_contains_key("kinds", F.lit(name)) if typed else field(name).isNotNull()


def wrong_types(integers: list[str], listed: list[str], said: list[str], typed: bool) -> list[tuple[str, Column]]:
    """With `kinds`, a quoted number is no integer, and a field without a value has no type that fits."""
    if typed:
        fits = {f: kind_is(f, "int") for f in integers} | {f: kind_is(f, "list") for f in listed}
        fits |= {f: kind_is(f, "str", *(["date"] if f in model.DATES else [])) for f in said}
        return [(f"type:{f}", there(f, True) & ~good) for f, good in fits.items()]
    out = [(f"type:{f}", field(f).isNotNull() & ~is_integer(f)) for f in integers]
    return out + [(f"type:{f}", field(f).isNotNull() & F.json_array_length(field(f)).isNull()) for f in listed]


def literal_rule(plugin: str | None) -> list[tuple[str, Column]]:
    return [("literal:plugin", ~field("plugin").eqNullSafe(F.lit(plugin)))] if plugin else []


def rules(typed: bool = False, plugin: str | None = None) -> list[tuple[str, Column]]:
    """[K1] All checks of an event note, in order: version, unknown, missing, type, enum, literal, invariants.
    Notes of the first version know fewer fields, and must have more of them."""
    first = field("schema_version").eqNullSafe(F.lit("1"))
    known = lambda fields: F.size(F.array_except(F.map_keys("fm"), F.array(*map(F.lit, fields)))) > 0
    version = ~F.coalesce(field("schema_version"), F.lit("")).isin("1", "2") | (~kind_is("schema_version", "int") if typed else F.lit(False))
    out = [("version", version), ("unknown-field", F.when(first, known(model.V1_FIELDS)).otherwise(known(model.FIELD_ORDER)))]
    needed = [f for f in model.FIELD_ORDER if f in model.REQUIRED or f in model.V1_REQUIRED]
    out += [(f"missing:{f}", ~there(f, typed) & (first if f not in model.REQUIRED else ~first if f not in model.V1_REQUIRED else F.lit(True))) for f in needed]
    out += wrong_types(model.INTEGERS, model.LISTS, [f for f in model.FIELD_ORDER if f not in model.INTEGERS + model.LISTS], typed)
    out += [(f"enum:{f}", there(f, typed) & ~F.coalesce(field(f).isin(values), F.lit(False))) for f, values in model.ENUMS.items()]
    return out + literal_rule(plugin) + invariants()


def index_note_rules(typed: bool = False, plugin: str | None = None) -> list[tuple[str, Column]]:
    """[K2, K4] Checks of a project's index note."""
    fields = model.INDEX_NOTE_REQUIRED + model.INDEX_NOTE_OPTIONAL
    out = [("unknown-field", F.size(F.array_except(F.map_keys("fm"), F.array(*map(F.lit, fields)))) > 0)]
    out += [(f"missing:{f}", ~there(f, typed)) for f in model.INDEX_NOTE_REQUIRED]
    if typed:
        out += [("version", ~F.coalesce(field("schema_version"), F.lit("")).isin("1", "2"))]
        out += wrong_types(["schema_version"], ["parties", "tags", "cssclasses"], [f for f in fields if f not in ("schema_version", "parties", "tags", "cssclasses")], True)
    out += [("enum:status", there("status", typed) & ~F.coalesce(field("status").isin(model.INDEX_NOTE_STATUS), F.lit(False)))]
    out += literal_rule(plugin)
    out += [(f"date:{f}", (F.coalesce(field(f), F.lit("")) != "") & ~is_iso_shape(field(f))) for f in ("timeline_start", "timeline_end")]
    return out + [("domain-path", F.coalesce(field("domain").rlike(r"[/\\]|^$"), F.lit(False)))]


def coded(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks]))


def violations(notes: DataFrame, only_invariants: bool = False, plugin: str | None = None) -> DataFrame:
    """[K1, K2, K11] note_path, pos, violation of notes (note_path, fm map<string,string>; lists
    as JSON). All are given; the one at pos 0 comes first. With a column `kinds` (what each value
    was written as) types are checked as a YAML reader sees them; `plugin` is the value that the
    field of that name must have."""
    typed = "kinds" in notes.columns
    event = coded(invariants() if only_invariants else rules(typed, plugin))
    found = F.when(field("note_type").eqNullSafe(F.lit(model.INDEX_NOTE_TYPE)), coded(index_note_rules(typed, plugin))).otherwise(event)
    return notes.select("note_path", F.posexplode(found).alias("pos", "violation"))


def read_notes(notes: DataFrame) -> DataFrame:
    """[A16] notes (note_path, text) with entries (what the frontmatter holds, in its order; null without a
    fence), fm (values by key), kinds, formed (whether it could be read whole) and body."""
    rows = notes.select("note_path", frontmatter.parsed(frontmatter.fence_of(F.col("text"))).alias("entries"), frontmatter.fence_of(F.col("text")).isNotNull().alias("fenced"), frontmatter.body_of(F.col("text")).alias("body"))
    rows = rows.withColumn("entries", F.when(F.col("fenced"), F.col("entries")))
    return rows.select("note_path", "fenced", "entries", frontmatter.by_key(F.col("entries"), "value").alias("fm"), frontmatter.by_key(F.col("entries"), "kind").alias("kinds"), frontmatter.well_formed(F.col("entries")).alias("formed"), "body")


def violations_of_text(notes: DataFrame, plugin: str | None = None) -> DataFrame:
    """[K1, K2, K11] note_path, pos, violation of notes (note_path, text): no-frontmatter or malformed, which
    hide all others, else the violations of its fields."""
    rows = read_notes(notes)
    head = F.when(~F.col("fenced"), "no-frontmatter").when(~F.col("formed"), "malformed")
    unread = rows.select("note_path", F.lit(0).alias("pos"), head.alias("violation")).where("violation is not null")
    return unread.union(violations(rows.where("fenced and formed"), plugin=plugin))


def upgrade(notes: DataFrame, today: str) -> DataFrame:
    """[K5] notes (note_path, fm, body, project, domain, mtime) -> note_path and the fields of the
    present schema as columns (lists as JSON). Idempotent. Confidence is derived from the
    sources again, and captions are not carried."""
    name = F.regexp_replace(F.element_at(F.split("note_path", "/"), -1), r"\.[^.]*$", "")
    keep = lambda f, default: F.coalesce(F.nullif(field(f), F.lit("")), default)
    listed = lambda f: F.when(items(f) > 0, field(f))
    one_of = lambda f, default: F.when(field(f).isin(model.ENUMS[f]), field(f)).otherwise(default)
    number = lambda f: F.when(field(f).rlike(r"^\d+$"), field(f).try_cast("bigint"))
    stored, own = F.when(is_iso_shape(field("event_date")), field("event_date")), date_prefix(name).cast("string")
    path = keep("source_path", source_path_of_body(F.col("body")))
    source = F.when(stored.isNotNull(), one_of("event_date_source", F.when(own == stored, "filename-prefix").otherwise("mtime"))).otherwise(F.when(own.isNotNull(), "filename-prefix").otherwise("mtime"))
    return notes.select(
        "note_path",
        F.lit(model.SCHEMA_VERSION).alias("schema_version"),
        keep("domain", F.col("domain")).alias("domain"),
        keep("project", F.col("project")).alias("project"),
        path.alias("source_path"),
        one_of("file_type", file_type(path)).alias("file_type"),
        F.lit(today).alias("captured_date"),
        F.coalesce(stored, own, F.to_date(F.timestamp_seconds("mtime")).cast("string")).alias("event_date"),
        source.alias("event_date_source"),
        one_of("scan_type", F.lit("retro")).alias("scan_type"),
        F.coalesce(listed("sources_read"), F.lit("[]")).alias("sources_read"),
        F.coalesce(number("read_bytes"), F.lit(0).cast("bigint")).alias("read_bytes"),
        F.when(items("sources_read") > 0, "high").otherwise("metadata-only").alias("content_confidence"),
        *[listed(f).alias(f) for f in ("attachments", "source_images", "tags")],
        number("images_embedded").alias("images_embedded"),
        F.coalesce(field("cssclasses"), F.lit("[]")).alias("cssclasses"),
    )


def upgrade_audit(notes: DataFrame, today: str) -> DataFrame:
    """[K6] field, n_changed between the stored and the upgraded notes (captured_date aside)."""
    names = ["schema_version", "domain", "project", "source_path", "file_type", "event_date", "event_date_source", "scan_type", "sources_read", "read_bytes", "content_confidence", "cssclasses"]
    after = upgrade(notes, today).select("note_path", F.struct(*[F.col(n).cast("string").alias(n) for n in names]).alias("after"))
    both = notes.select("note_path", "fm").join(after, "note_path")
    changed = F.filter(F.array(*[F.struct(F.lit(n).alias("field"), (~field(n).eqNullSafe(F.col(f"after.{n}"))).alias("differs")) for n in names]), lambda x: x["differs"])
    return both.select(F.explode(changed).alias("x")).groupBy(F.col("x.field").alias("field")).agg(F.count("*").alias("n_changed"))
