"""Pages in parts against pages in rows, updates of existing pages, and what pages say of themselves."""

import datetime
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliary import model
from foliary.operators import clusters, config, reports
from foliary.plans import scan
from foliary.sources import archive, note_files
from tests.test_skew import event, random_events

TODAY = datetime.date(2025, 1, 1)


def frame(spark, own):
    return spark.createDataFrame(own, model.EVENT).repartition(3)


def put_together(parts, key):
    """The parts of each page, one after another."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("l"))
    return {r[0]: "".join(x.text for x in r.l) for r in rows.collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_parts_are_the_page(spark, seed):
    own = random_events(200, seed, ("p", "q: r", "s")) + [event("only undated", None, "x", "", [], 1), event("one", 3, "y", "a", ["z"], 2)]
    events = frame(spark, own)
    want = {r.project: r.page for r in scan.project_pages(events, TODAY).collect()}
    assert put_together(scan.page_parts(events, TODAY), "project") == want


def test_a_page_of_very_many_events(spark, tmp_path):
    """100,000 events of one project: no row of the parts is longer than a line, and the file is whole."""
    events = spark.range(100_000).select(
        F.lit("p").alias("project"), F.date_add(F.lit(datetime.date(2000, 1, 1)), (F.col("id") % 5000).cast("int")).alias("event_date"), F.concat(F.lit("2000 n"), F.col("id").cast("string")).alias("note_filename"),
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("subfolder"), F.col("id").alias("ord"), F.array().cast("array<string>").alias("parties"), F.lit("").alias("summary_hint"), F.lit("").alias("fallback_hint"),
    )
    parts = scan.page_parts(events, TODAY)
    assert parts.agg(F.max(F.char_length("text"))).first()[0] < 200
    note_files.write(parts.select(F.concat("project", F.lit(".md")).alias("path"), "part", "text"), f"file://{tmp_path}/v")
    lines = (tmp_path / "v" / "p.md").read_text().split("\n")
    assert sum(x.startswith("- ==") for x in lines) == 100_000 and lines[:2] == ["---", "project: p"]


def test_report_parts_are_the_report(spark):
    at = datetime.datetime(2024, 8, 1, 9)
    own = spark.createDataFrame([(k, "retro", at, at + datetime.timedelta(hours=k)) for k in range(3)], "report long, kind string, started timestamp, finished timestamp")
    counts = spark.createDataFrame([(0, 0, "notes", 120), (0, 1, "images", 3), (1, 0, "notes", 0)], "report long, ord long, name string, value long")
    notes = spark.createDataFrame([(0, k, f"n{k:03}") for k in range(120)] + [(2, 7, "x")], "report long, ord long, path string")
    warnings = spark.createDataFrame([(0, k, f"w{k}") for k in range(300)], "report long, ord long, text string")
    want = {r.report: r.body for r in reports.scan_reports(own, counts, notes, warnings).collect()}
    assert put_together(reports.scan_report_parts(own, counts, notes, warnings), "report") == want


def test_updates_keep_what_users_wrote(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    events = frame(spark, [event("p", k, f"n{k}", "a", ["x"], k) for k in range(3)] + [event("q", 0, "m", "a", [], 9)])
    os.mkdir(tmp_path / "v")
    (tmp_path / "v" / "p.md").write_text("# mine\n\n[begin]\nold\n[stop]\n\n## Thoughts\nkept")
    (tmp_path / "v" / "other.md").write_text("not a project")
    update = lambda: {r.project for r in scan.update_pages(events, root, TODAY, "[begin]", "[stop]").collect()}
    assert update() == {"p", "q"}
    fresh = {r.project: r.page for r in scan.project_pages(events, TODAY).collect()}
    assert (tmp_path / "v" / "p.md").read_text() == f"# mine\n\n[begin]\n{fresh['p']}\n[stop]\n\n## Thoughts\nkept"
    assert (tmp_path / "v" / "q.md").read_text() == f"[begin]\n{fresh['q']}\n[stop]"
    before = {f: os.stat(tmp_path / "v" / f).st_mtime_ns for f in ("p.md", "q.md", "other.md")}
    assert update() == set()
    assert {f: os.stat(tmp_path / "v" / f).st_mtime_ns for f in before} == before


def test_properties_of_pages(spark):
    pages = {
        '<html lang=de><head><META CHARSET=utf-8><title> A\n b </title><meta content=\'x > "y"\' name="Author">': ("A\n b", "de", "utf-8", 'x > "y"', None),
        '<meta property="article:published_time" content="2024"><meta name="date" content="2023">': (None, None, None, None, "2024"),
        '<meta name="author" content="  "><meta name="article:author" content="second">': (None, None, None, "second", None),
        "<title></title><html>": (None, None, None, None, None),
        "": (None, None, None, None, None),
    }
    rows = spark.createDataFrame([(k,) for k in pages], "h string").select("h", *[archive.page_property(F.col("h"), n).alias(n) for n in ("title", "language", "charset", "author", "published")])
    assert {r.h: tuple(r)[1:] for r in rows.collect()} == pages
    assert spark.createDataFrame([('<meta name="X-Own" content="v">',)], "h string").select(archive.page_property(F.col("h"), "x-own")).first()[0] == "v"


def test_settings_of_one_project_only(spark):
    lists = ", ".join(f"{c} array<string>" for c in config.LISTS)
    none = ([], [], [], [])
    domains = spark.createDataFrame([("d", "t", "/a", *none, "", {})], f"name string, template string, archive_root string, {lists}, fallback string, style map<string,string>")
    templates = spark.createDataFrame([("t", *none, "T", {})], f"name string, {lists}, fallback string, style map<string,string>")
    schema = f"{lists}, fallback string, style map<string,string>, global_style map<string,string>"
    project = lambda n: spark.createDataFrame([(*none, "P", {}, {})] * n, schema)
    assert config.effective(domains, templates, project(1)).first().fallback == "P"
    assert config.effective(domains, templates, project(0)).first().fallback == "T"
    with pytest.raises(PySparkException, match="more than one project"):
        config.effective(domains, templates, project(2)).collect()
    assert clusters.GAP_DAYS == 7
