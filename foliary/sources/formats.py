"""Text of files, by their category, from a binary column."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.operators.rows import first_seen, images_to_embed

CODECS = ["utf-8", "gbk", "shift_jis", "latin-1"]


@dataclass(frozen=True)
class Limits:
    """The most that is read of a file; None: all. The survey's limits are `SURVEYED`."""

    bytes: int | None = None
    paragraphs: int | None = None
    slides: int | None = None
    rows: int | None = None
    columns: int | None = None


# 8 MB of plain text, 5,000 paragraphs, 300 slides, 2,000 rows and 50 columns of a sheet.
SURVEYED = Limits(8 << 20, 5000, 300, 2000, 50)


class Cut(list):
    """What was left out, by name."""

    def first(self, items: list, most: int | None, name: str) -> list:
        if most is not None and len(items) > most:
            self.append(f"{name}: {len(items) - most} of {len(items)}")
            return items[:most]
        return items


def plain_text(raw: bytes, limits: Limits = Limits(), cut: Cut | None = None) -> str:
    """[A35] By its byte-order mark, else the first codec that fits."""
    whole = len(raw)
    if limits.bytes is not None and whole > limits.bytes:
        raw = raw[: limits.bytes]
        (cut if cut is not None else Cut()).append(f"bytes: {whole - limits.bytes} of {whole}")
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(codec, "replace")
    if len(raw) < whole:  # a cut may have gone through a character
        for less in range(4):
            try:
                return raw[: len(raw) - less].decode("utf-8")
            except UnicodeDecodeError:
                continue
    for codec in CODECS:
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return ""


def _texts(xml: bytes, block: str, piece: str) -> list[str]:
    local = lambda tag: tag.rsplit("}", 1)[-1]
    return ["".join(t.text or "" for t in b.iter() if local(t.tag) == piece) for b in ElementTree.fromstring(xml).iter() if local(b.tag) == block]


def _numbered(names: list[str], pattern: str) -> list[str]:
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def docx_text(raw: bytes, limits: Limits = Limits(), cut: Cut | None = None) -> str:
    """[A32] Paragraphs, those in tables too."""
    cut = cut if cut is not None else Cut()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return "\n".join(cut.first(_texts(z.read("word/document.xml"), "p", "t"), limits.paragraphs, "paragraphs"))


def pptx_text(raw: bytes, limits: Limits = Limits(), cut: Cut | None = None) -> str:
    """[A33]"""
    cut = cut if cut is not None else Cut()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = cut.first(_numbered(z.namelist(), r"ppt/slides/slide\d+\.xml"), limits.slides, "slides")
        return "\n".join(t for s in slides for t in _texts(z.read(s), "p", "t") if t)


def xlsx_text(raw: bytes, limits: Limits = Limits(), cut: Cut | None = None) -> str:
    """[A34] Tab-joined cells, sheet after sheet."""
    cut = cut if cut is not None else Cut()
    local = lambda tag: tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = _texts(z.read("xl/sharedStrings.xml"), "si", "t") if "xl/sharedStrings.xml" in z.namelist() else []
        lines = []
        for sheet in _numbered(z.namelist(), r"xl/worksheets/sheet\d+\.xml"):
            rows = [r for r in ElementTree.fromstring(z.read(sheet)).iter() if local(r.tag) == "row"]
            for row in cut.first(rows, limits.rows, "rows"):
                cells = []
                for c in cut.first([c for c in row if local(c.tag) == "c"], limits.columns, "columns"):
                    value = "".join(v.text or "" for v in c.iter() if local(v.tag) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                lines.append("\t".join(cells))
        return "\n".join(lines)


READERS = {"txt": plain_text, "md": plain_text, "rst": plain_text, "csv": plain_text, "docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text}
# The first bytes of image files, as hexadecimal digits.
MAGIC = {"png": "89504E470D0A1A0A", "jpg": "FFD8FF", "gif": "47494638", "bmp": "424D", "tiff": "49492A00|4D4D002A"}


def image_kind(content: Column) -> Column:
    """By the first bytes; bin for others, null for null."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.when(content.isNull(), F.lit(None).cast("string")).when(head.rlike("^52494646.{8}57454250"), "webp")
    for name, start in MAGIC.items():
        kind = kind.when(head.rlike(f"^(?:{start})"), name)
    return kind.otherwise("bin")


def embedded(raw: bytes) -> list[tuple[str, bytes]]:
    """[A39] Images in a text document or slides: (name, bytes). Spreadsheets give none."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [(n.rsplit("/", 1)[-1], z.read(n)) for n in sorted(z.namelist()) if re.match(r"(word|ppt)/media/.", n)]


def extract_text(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None, limits: Limits = Limits()) -> DataFrame:
    """[A40, A41, A31-A35] files (path, content) -> path, text, error, cut. readers: more of them by
    extension, for example of a PDF library that is at hand, or other ones for known types. Types
    without a reader give an error; one bad file never fails the others. Files are read whole
    unless limits say otherwise; then cut names what was left out."""
    more = readers or {}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                kind, cut = path.rsplit(".", 1)[-1].lower(), Cut()
                try:
                    if kind in more:
                        text = more[kind](raw)
                    elif kind in READERS:
                        text = READERS[kind](raw, limits, cut)
                    else:
                        rows.append((path, "", "no reader", None))
                        continue
                    rows.append((path, text, None, "; ".join(cut) or None))
                except Exception as e:  # a broken file is a row, not a failed task
                    rows.append((path, "", f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=["path", "text", "error", "cut"])

    return files.select("path", "content").mapInPandas(read, "path string, text string, error string, cut string")


def extract_images(files: DataFrame) -> DataFrame:
    """[A39] files (path, content) -> path, k, name, kind, content, error of embedded images; a file that can't
    be read, in whole or in part, is one row with an error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, k, name, b, None) for k, (name, b) in enumerate(embedded(raw))]
                except Exception as e:  # truncated or encrypted entries too
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            found = pd.DataFrame(rows, columns=["path", "k", "name", "content", "error"])
            found["k"] = found["k"].astype("Int32")
            yield found

    found = files.select("path", "content").mapInPandas(read, "path string, k int, name string, content binary, error string")
    return found.select("path", "k", "name", image_kind(F.col("content")).alias("kind"), "content", "error")


def embedded_images(files: DataFrame, candidates: int = 20, embed: int = 10, least_bytes: int = 10_000) -> DataFrame:
    """[R20] sha256, path, name, kind, row, content of the images that notes of these files (path, content) would
    show: of each file's images the first ones that are large enough, one of each content; of those that
    stand in several files the first by path, which is where its bytes are to be written."""
    found = extract_images(files).where("error is null").select(F.col("path").alias("note"), F.col("k").alias("ord"), "name", "kind", "content", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    chosen = images_to_embed(found.drop("content"), candidates, embed, least_bytes)
    first = first_seen(chosen.withColumn("at", F.struct("note", "ord")), "sha256", "note", "at").select("sha256", F.col("note").alias("first_note"), F.col("at.ord").alias("first_ord"))
    bodies = found.select(F.col("note").alias("first_note"), F.col("ord").alias("first_ord"), "content")
    return chosen.join(first, "sha256").join(bodies, ["first_note", "first_ord"]).select("sha256", F.col("note").alias("path"), "name", "kind", "row", (F.col("note").eqNullSafe(F.col("first_note")) & (F.col("ord") == F.col("first_ord"))).alias("write"), "content")
