"""Event detection, settings, sinks and plug-ins."""

import io
import os
import time
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliary import model
from foliary.operators import config, detect, rows
from foliary.sources import formats, plugins, writers


def test_detection(spark):
    paths = ["240110 site/a.jpg", "240110 site/b.pdf", "SD/plan.pdf", "SD/x.dwg", "SD/loose.png", "240301 late/sub/c.docx", "Admin/_Attachments/y.pdf", "SD/n.txt", "a.png"]
    got = {r.path: (r.event, r.kind) for r in detect.detect_events(spark.createDataFrame([("P", p) for p in paths] + [("Q", "z.png")], "project string, path string")).collect()}
    assert got == {
        "240110 site/a.jpg": ("240110 site", "folder"), "240110 site/b.pdf": ("240110 site", "folder"), "SD/plan.pdf": ("SD/plan.pdf", "document"), "SD/x.dwg": ("SD/x.dwg", "metadata-only"),
        "SD/loose.png": ("240110 site", "linked-image"), "240301 late/sub/c.docx": ("240301 late/sub/c.docx", "document"), "SD/n.txt": (None, "skip"), "a.png": ("240110 site", "linked-image"), "z.png": (None, "skip"),
    }


def test_settings(spark):
    lists = ", ".join(f"{c} array<string>" for c in config.LISTS)
    domains = spark.createDataFrame([("d", "t", "/a", ["b", "c"], [], ["x"], [], "", {"k": "domain", "d": "1"})], f"name string, template string, archive_root string, {lists}, fallback string, style map<string,string>")
    templates = spark.createDataFrame([("t", ["a", "b"], [], ["y", "x"], ["g"], "T", {"k": "template", "t": "1"})], f"name string, {lists}, fallback string, style map<string,string>")
    project = spark.createDataFrame([(["c", "p"], None, None, None, None, {"p": "1"}, {"t": "global"})], f"{lists}, fallback string, style map<string,string>, global_style map<string,string>")
    got = config.effective(domains, templates, project).first()
    assert (got.routing_patterns, got.skip_patterns, got.default_tags, got.fallback) == (["c", "p", "b", "a"], ["x", "y"], ["g"], "T")
    assert got.style == {"k": "domain", "d": "1", "t": "global", "p": "1"}
    old = config.effective(domains, templates, project, legacy=True).first()
    assert old.routing_patterns == ["c", "p", "b", "c", "a", "b"] and old.style["t"] == "1"


def test_registry(spark):
    df = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    got = config.handler_registry(df([("pdf", "document"), ("txt", "text"), ("zip", "archive")], "ext string, category string"), df([("text", "notes")], "category string, to string"), df([("pdf", "mine"), ("xyz", "odd")], "ext string, category string"), df([("zip",)], "ext string"))
    assert {r.ext: r.category for r in got.collect()} == {"pdf": "mine", "txt": "notes", "xyz": "odd"}


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/m"
    for k in (1, 2, 3):
        writers.write_manifest(spark.createDataFrame([(f"/{k}", k, k)], model.MANIFEST), root, k)
    assert [r.path for r in writers.newest_manifest(spark, root).collect()] == ["/3"]
    assert [r.path for r in writers.newest_manifest(spark, root, before=3).collect()] == ["/2"]
    assert writers.prune_manifests(spark, root) == [1] and writers.prune_manifests(spark, root) == []
    assert [r.path for r in writers.newest_manifest(spark, root).collect()] == ["/3"]


def test_index_refuses_tabs(spark, tmp_path):
    good = spark.createDataFrame([("/a", "1", "n", 0)], model.INDEX)
    writers.append_index(good, f"file://{tmp_path}/i")
    with pytest.raises(PySparkException):
        writers.append_index(good.withColumn("note_path", F.lit("a\tb")), f"file://{tmp_path}/i")
    assert spark.read.parquet(f"file://{tmp_path}/i").count() == 1


def test_capped_log(spark):
    entry = lambda k: (f"{k}", "t", "s", None, k)
    old, new = spark.createDataFrame([entry(k) for k in range(199)], model.LOG), spark.createDataFrame([entry(k) for k in range(3)], model.LOG)
    got = writers.capped_log(old, new)
    assert got.count() == 200 and got.agg(F.max("ord"), F.min("ord")).first() == (201, 2)


def test_guard_and_append(spark):
    text = "body"
    digest = spark.range(1).select(F.sha2(F.lit(text).cast("binary"), 256)).first()[0]
    present = spark.createDataFrame([("same", text, digest), ("old", text, digest), ("edited", text + "!", digest)], "name string, text string, stored_hash string")
    rendered = spark.createDataFrame([("same", text), ("old", "new"), ("edited", "new"), ("fresh", "new")], "name string, text string")
    assert {r.name: r.target for r in writers.guarded(rendered, present).collect()} == {"same": "none", "old": "file", "edited": "sidecar", "fresh": "file"}
    notes = spark.createDataFrame([("n", "x\n"), ("m", "y")], "note_path string, body string")
    got = writers.appended(notes, spark.createDataFrame([("n", "S")], "note_path string, section string"))
    assert {r.note_path: r.body for r in got.collect()} == {"n": "x\n\nS\n", "m": "y"}


def test_attachments(spark, tmp_path):
    files = spark.createDataFrame([("h1", "b.png", 2), ("h1", "a.png", 1), ("h2", "c.png", 3)], "sha256 string, filename string, ord int")
    writers.write_attachments(files, f"file://{tmp_path}/a")
    assert {r.sha256: (r.filename, r.hits) for r in spark.read.parquet(f"file://{tmp_path}/a").collect()} == {"h1": ("a.png", 2), "h2": ("c.png", 1)}
    assert rows.first_seen(files, "sha256", "filename").count() == 2


def test_plugin_source(spark):
    plugins.register(spark, "numbers", lambda root: ((f"{root}/{k}", k, 0) for k in range(3)))
    got = spark.read.format("numbers").option("roots", "/a,/b").load()
    assert sorted(r.path for r in got.collect()) == ["/a/0", "/a/1", "/a/2", "/b/0", "/b/1", "/b/2"]


def test_fetches_have_a_time_limit(spark):
    def read(path):
        if path == "slow":
            time.sleep(3)
        if path == "bad":
            raise OSError("no")
        return path.encode()

    got = {r.path: (r.content, r.error) for r in plugins.fetch(spark.createDataFrame([("ok",), ("slow",), ("bad",)], "path string"), read, 1.0).collect()}
    assert got["ok"] == (bytearray(b"ok"), None) and got["slow"][1] == "timeout" and got["bad"][1] == "OSError: no"


def test_every_read_has_its_own_outcome(spark):
    """Ten files of a hundred hang, one kills its reader, and all in one task."""

    def read(path):
        k = int(path[1:])
        if k % 10 == 3:
            time.sleep(600)
        if k == 50:
            os._exit(1)
        return path.encode() * 1000

    df = spark.createDataFrame([(f"p{k}",) for k in range(100)], "path string").coalesce(1)
    began = time.monotonic()
    got = {r.path: (r.content, r.error) for r in plugins.fetch(df, read, 0.5).collect()}
    assert time.monotonic() - began < 60
    assert [p for p, (_, e) in got.items() if e == "timeout"] == [f"p{k}" for k in range(3, 100, 10)]
    assert got["p50"] == (None, "the reader died")
    assert sum(c == bytearray(p.encode() * 1000) for p, (c, _) in got.items()) == 89


def test_readers_at_hand(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.pdf2", bytearray(b"y"))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in formats.extract_text(df, {"pdf": lambda raw: raw.decode() * 2}).collect()}
    assert got == {"a.pdf": ("xx", None), "b.pdf2": ("", "no reader")}


def test_gates(spark):
    schema = "text string, images int, captions array<string>, body string"
    got = detect.compose_gate(spark.createDataFrame([("", 0, None, ""), ("x", 0, [], "as an AI"), (None, 2, None, "fine")], schema), ["as an ai"]).collect()
    assert [(r.compose, r.reasons) for r in got] == [(False, ["empty"]), (True, ["stop word: as an ai"]), (True, [])]
    stubs = spark.createDataFrame([("a", "# TODO"), ("b", 'def read_text(p):\n    return ""\n\ndef extract_images(p, o):\n    return []\n'), ("c", "def read_text(p):\n    return open(p).read()\n")], "path string, value string")
    assert {r.path: r.stub for r in detect.is_stub(stubs).collect()} == {"a": True, "b": True, "c": False}
    assert [r.v for r in spark.createDataFrame([("1", "1"), ("1", "2"), (None, "2")], "a string, b string").select(config.version_notice(F.col("a"), F.col("b")).alias("v")).collect()] == [False, True, False]


def zipped(entries, broken=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    raw = bytearray(out.getvalue())
    if broken:
        raw[40] ^= 0xFF
    return raw


def test_limits_are_asked_for_and_said(spark):
    sheet = "<x><row>" + "<c><v>1</v></c>" * 3 + "</row><row><c><v>2</v></c></row></x>"
    doc = "<d>" + "<p><t>x</t></p>" * 4 + "</d>"
    files = spark.createDataFrame([("a.txt", bytearray("é" * 10, "utf-8")), ("b.docx", zipped({"word/document.xml": doc})), ("c.xlsx", zipped({"xl/worksheets/sheet1.xml": sheet})), ("d.pptx", zipped({f"ppt/slides/slide{k}.xml": "<s><p><t>y</t></p></s>" for k in (1, 2, 3)}))], "path string, content binary")
    whole = {r.path: (r.text, r.cut) for r in formats.extract_text(files).collect()}
    assert whole == {"a.txt": ("é" * 10, None), "b.docx": ("x\nx\nx\nx", None), "c.xlsx": ("1\t1\t1\n2", None), "d.pptx": ("y\ny\ny", None)}
    few = {r.path: (r.text, r.cut) for r in formats.extract_text(files, limits=formats.Limits(5, 3, 2, 1, 2)).collect()}
    assert few == {"a.txt": ("éé", "bytes: 15 of 20"), "b.docx": ("x\nx\nx", "paragraphs: 1 of 4"), "c.xlsx": ("1\t1", "rows: 1 of 2; columns: 1 of 3"), "d.pptx": ("y\ny", "slides: 1 of 3")}


def test_images_of_files(spark):
    png, jpg = b"\x89PNG\r\n\x1a\n" + b"1" * 20_000, b"\xff\xd8\xff" + b"2" * 20_000
    files = {
        "a.docx": zipped({"word/media/1.png": png, "word/media/2.jpg": jpg, "word/media/3.png": png, "word/media/4.gif": b"GIF8 small"}),
        "b.pptx": zipped({"ppt/media/x.jpg": jpg}), "c.xlsx": zipped({"xl/media/1.png": png}), "d.docx": zipped({"word/media/1.png": png}, broken=True), "e.docx": bytearray(b"no archive"),
    }
    df = spark.createDataFrame(list(files.items()), "path string, content binary").repartition(2)
    got = formats.extract_images(df).collect()
    assert sorted((r.path, r.k, r.kind) for r in got if r.error is None) == [("a.docx", 0, "png"), ("a.docx", 1, "jpg"), ("a.docx", 2, "png"), ("a.docx", 3, "gif"), ("b.pptx", 0, "jpg")]
    assert sorted(r.path for r in got if r.error) == ["d.docx", "e.docx"]
    shown = sorted((r.path, r.name, r.kind, r.row, r.write) for r in formats.embedded_images(df).collect())
    assert shown == [("a.docx", "1.png", "png", 0, True), ("a.docx", "2.jpg", "jpg", 0, True), ("b.pptx", "x.jpg", "jpg", 0, False)]


def test_image_kinds(spark):
    heads = {b"\x89PNG\r\n\x1a\n.": "png", b"\xff\xd8\xff.": "jpg", b"GIF89a": "gif", b"BM..": "bmp", b"II*\x00": "tiff", b"MM\x00*": "tiff", b"RIFF....WEBPVP8": "webp", b"RIFF....WAVE": "bin", b"": "bin", b"x\x89PNG": "bin"}
    rows_ = spark.createDataFrame([(bytearray(b),) for b in heads] + [(None,)], "c binary").select("c", formats.image_kind(F.col("c")).alias("k")).collect()
    assert {bytes(r.c): r.k for r in rows_ if r.c is not None} == heads and [r.k for r in rows_ if r.c is None] == [None]
