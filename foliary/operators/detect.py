"""Which files and folders are events, and which of them get a note."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.dates import date_prefix
from foliary.functions.paths import extension
from foliary.operators.rows import filled

# Fixed values.
DOCUMENTS = ["pdf", "docx", "pptx", "xlsx"]
MODELS = ["dwg", "rvt", "3dm", "skp"]
IMAGES = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif", "heic", "heif"]
SKIPPED_FOLDERS = ["_embedded_files", "_Attachments", ".thumbs"]


def detect_events(files: DataFrame) -> DataFrame:
    """[C17] files (project, path below the project) -> project, path, event, kind.

    A dated leaf folder is one event with all its files; a document or model elsewhere is an
    event of its own (models: metadata only); an image elsewhere is linked to the dated event
    of its project that stands before it in path order, else the first one after it, else it is
    skipped; files in the skipped folders, and other files, are no events."""
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise("")
    rows = files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS)))).select("project", "path", folder.alias("folder"), extension(F.col("path")).alias("ext"))
    inner = rows.select("project", F.col("folder").alias("child")).distinct()
    # A folder is no leaf if another folder lies below it: every folder names its ancestors.
    pieces = F.split("child", "/")
    above = inner.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), "/"))).alias("folder"), "child").where("folder <> child")
    leaf = inner.withColumnRenamed("child", "folder").join(above.select("project", "folder").distinct(), ["project", "folder"], "left_anti")
    dated = leaf.where(date_prefix(F.element_at(F.split("folder", "/"), -1)).isNotNull()).select("project", "folder", F.lit(True).alias("dated"))
    own = F.when(F.col("dated"), F.col("folder"))
    rows = filled(rows.join(dated, ["project", "folder"], "left"), ["project"], "path", own)
    image = F.col("ext").isin(IMAGES)
    kind = F.when(F.col("dated"), "folder").when(F.col("ext").isin(DOCUMENTS), "document").when(F.col("ext").isin(MODELS), "metadata-only")
    event = F.coalesce(own, F.when(kind.isNotNull(), F.col("path")), F.when(image, F.coalesce("before", "after")))
    return rows.select("project", "path", event.alias("event"), F.coalesce(kind, F.when(image & event.isNotNull(), "linked-image"), F.lit("skip")).alias("kind"))


def compose_gate(events: DataFrame, stop_words: list[str] = ()) -> DataFrame:
    """[C2, C15, C16] events (text, images, captions, body) with compose (something to write about),
    excerpt, and reasons why the body is refused."""
    something = (F.coalesce("text", F.lit("")) != "") | (F.coalesce("images", F.lit(0)) > 0) | (F.size(F.coalesce("captions", F.array().cast("array<string>"))) > 0)
    low = F.lower(F.coalesce("body", F.lit("")))
    reasons = [F.when(F.trim(low) == "", F.lit("empty")), *[F.when(F.contains(low, F.lit(w.lower())), F.lit(f"stop word: {w}")) for w in stop_words]]
    return events.withColumn("compose", something).withColumn("excerpt", F.left("text", F.lit(4000))).withColumn("reasons", F.array_compact(F.array(*reasons)))


def note_body(notes: DataFrame, in_row: int = 3) -> DataFrame:
    """[F18, W12] note, body: prose, then embeds in rows of three."""
    many = F.transform(F.sequence(F.lit(0), F.floor((F.size("embeds") - 1) / in_row).cast("int")), lambda r: F.array_join(F.slice("embeds", r * in_row + 1, in_row), "\n"))
    grid = F.when(F.size("embeds") > 0, F.array_join(many, "\n\n"))
    prose = F.nullif(F.regexp_replace(F.coalesce("prose", F.lit("")), r"\s+$", ""), F.lit(""))
    return notes.select("note", F.concat_ws("\n\n", prose, grid).alias("body"))


def auto_applied(found: DataFrame, confidence: float = 0.8, matches: int = 5) -> DataFrame:
    """[C19] Detections that are certain enough to be applied without asking."""
    return found.where((F.col("confidence") >= confidence) & (F.col("match_count") >= matches))


def is_stub(sources: DataFrame, markers: list[str] = ("TODO", "NotImplementedError")) -> DataFrame:
    """[C21] handler sources (path, value) with stub: a marker, or only trivial returns in both functions."""
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains("value", F.lit(m))
    trivial = lambda name: F.col("value").rlike(rf"(?m)^def {name}\([^\n]*\n(?:\s+#[^\n]*\n)*\s+return (?:\"\"|''|\[\]|None)\s*$")
    return sources.withColumn("stub", marked | (trivial("read_text") & trivial("extract_images")))


def coverage(handlers: DataFrame, categories: DataFrame) -> DataFrame:
    """[E13] category, state (missing, stub, real): one stub makes the category a stub."""
    own = handlers.groupBy("category").agg(F.bool_or("stub").alias("stub"))
    return categories.join(own, "category", "left").select("category", F.when(F.col("stub").isNull(), "missing").when(F.col("stub"), "stub").otherwise("real").alias("state"))


def folder_sample(files: DataFrame, n: int = 20) -> DataFrame:
    """[A7, A8, S6] The first n files of each folder by path, without hidden and temporary ones."""
    shown = files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^\.|\.tmp$"))
    return shown.withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).where(F.col("k") <= n)


def calendar(events: DataFrame) -> DataFrame:
    """[F26, T8] start and end of an all-day entry and its description."""
    good = F.col("event_date").rlike(r"^.{4}-.{2}-.{2}$")
    at = lambda time: F.when(good, F.concat("event_date", F.lit(time))).otherwise(F.col("event_date"))
    return events.select("note_path", at("T00:00:00").alias("start"), at("T23:59:59").alias("end"), F.concat(F.lit("Note: "), "note_path", F.lit("\nSource: "), "source_path").alias("description"))


def source_plan(topics: DataFrame) -> DataFrame:
    """topic, searches, urls: five queries in English, five in Chinese where chinese is true."""
    said = lambda *ends: F.array(F.col("topic"), *[F.concat(F.lit(a), "topic", F.lit(b)) for a, b in ends])
    english = said(('"', '" company profile'), ('"', '" founder CEO'), ('"', '" recent news'), ('"', '" culture'))
    chinese = said(("", " 简介"), ("", " 创始人"), ("", " 最新动态"), ("", " 文化"))
    page = lambda lang: F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), F.replace("topic", F.lit(" "), F.lit("_")))
    none = F.array().cast("array<string>")
    return topics.select("topic", english.alias("english"), F.when(F.col("chinese"), chinese).otherwise(none).alias("chinese"), F.array_compact(F.array(page("en"), F.when(F.col("chinese"), page("zh")))).alias("urls"))
