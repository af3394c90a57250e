"""Hand-made cases of the archive operators."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliary import model
from foliary.functions import dates, paths, scoring, text, urls
from foliary.operators import clusters, duplicates, links, lookup, research, routing, rows, validate, votes
from foliary.plans import scan
from foliary.sources import archive, formats
from foliary.streaming import deltas


def values(spark, column, *inputs):
    """The column's value for each input, which it sees as x (or as a, b, ...)."""
    names = ["x"] if not isinstance(inputs[0], tuple) else list("abc")[: len(inputs[0])]
    df = spark.createDataFrame([(k, *(i if isinstance(i, tuple) else (i,))) for k, i in enumerate(inputs)], f"k int, {', '.join(f'{n} string' for n in names)}")
    return [r.v for r in df.select("k", column.alias("v")).orderBy("k").collect()]


@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    """Columns need a session, so they are made here and not on import."""
    globals().update(X=F.col("x"), A=F.col("a"), B=F.col("b"))


def day(text_):
    return datetime.date.fromisoformat(text_)


def test_date_prefixes(spark):
    names = ["2024-08-15 plan.pdf", "240815-plan", "240815", "700101_x", "691231.x", "2024-02-30 x", "2024-02-30", "24081x", "2408155", "plan 240815", "0000-01-01 x", "2024-2-3 x"]
    got = values(spark, dates.date_prefix(X).cast("string"), *names)
    assert got == ["2024-08-15", "2024-08-15", "2024-08-15", "1970-01-01", "2069-12-31", None, None, None, None, None, None, None]


def test_paths(spark):
    assert values(spark, paths.project_of_note(X), "d/p/s/n.md", "p/n.md", "n.md") == ["p", "p", "n.md"]
    assert values(spark, paths.project_of_note(X, "legacy"), "d/p/s/n.md", "n.md") == ["d", "n.md"]
    assert values(spark, paths.archive_parent(A, B), ("/archive/arch/P/SD/f.pdf", "P"), ("/archive/P/f.pdf", "P"), ("/a/b/c.pdf", "P"), ("/P/c.pdf", "P")) == ["/archive/arch", "/archive", "/a", "/"]
    assert values(spark, paths.shared_leading(A, B), ("/nas/a/b/x", "/nas/a/c/x"), ("/nas/x", "/nas/y"), ("/a", "/b"), ("", "/b")) == [1, 0, 0, 0]
    assert values(spark, paths.without_md(X), "a.md", "a.md.md", "a") == ["a", "a.md", "a"]
    assert values(spark, paths.file_type(X), "a/b.JPEG", "a/b", "x.tar.gz", "x.htm") == ["jpg", "folder", "other", "html"]
    assert values(spark, paths.category(X), "a.PDF", "a.mov", "a.xyz") == ["document-pdf", "video", None]
    assert values(spark, paths.batch_slug(X), "--A b!c--", "x" * 40, "é") == ["a-b-c", "x" * 30, ""]
    assert values(spark, paths.attachments_root(X), "d/p/s", "p") == ["d/p", "p"]
    assert values(spark, paths.join_path(A, B), ("d/", "/p"), ("", "p"), (" d ", "")) == ["d/p", "p", "d"]


def test_prefixes_end_at_components(spark):
    assert values(spark, paths.rewrite_prefix(X, "d/X", "d/X Final"), "d/X/n", "d/X Final/n", "d/X") == ["d/X Final/n", "d/X Final/n", "d/X Final"]
    assert values(spark, paths.rewrite_prefix(X, "d/X", "d/X Final", boundary=False), "d/X Final/n") == ["d/X Final Final/n"]


@pytest.mark.parametrize("pattern, yes, no", [("*.tmp", "a/b.tmp/c", "a/b.tmpx"), (".*", "a/.git/x", "a/b"), ("_?[ab]", "x/_1a", "x/_1c"), ("[!a]b", "cb", "ab"), ("a+(b)", "a+(b)", "aab"), ("[", "[", "a")])
def test_globs(spark, pattern, yes, no):
    assert values(spark, paths.any_segment_matches(X, [pattern]), yes, no) == [True, False]


def test_tokens(spark):
    got = values(spark, F.array_join(F.array_sort(text.tokens(X)), " "), "2024-08-15 The Site_Visit notes, v2 a", "施工图 review", "", "event drawing CD")
    assert got == ["notes site_visit v2", "review 图 工 施", "", ""]


def test_text(spark):
    assert values(spark, text.confidence(X), None, "", "a" * 100, "a" * 101) == ["none", "none", "low", "high"]
    assert values(spark, text.gantt_escape(X), 'a:b"`', "", None) == ["a-b", "_", "_"]
    assert values(spark, text.normalized_stem(X), "Ünïcode  Näme!", "图", "ﬁle") == ["unicode-name", "image", "file"]
    assert values(spark, text.topic_slug(X, 12), "alpha beta gamma", "alphabetagammadelta", "alpha beta-x gamma") == ["alpha-beta", "alphabetagam", "alpha-beta-x"]
    body = "x\n" + text.MARKER_START + "\nold\n" + text.MARKER_END
    once = values(spark, text.strip_marked(X), body)[0]
    assert once == "x\n" and values(spark, text.strip_marked(X), once) == [once]
    assert values(spark, text.abstract(X), "# T\n> [!abstract] A\n> one two\n> three\n\nrest", "# T\nIt has six words in all. More.", "Too short. x") == ["one two three", "It has six words in all.", ""]
    assert values(spark, text.fallback_hint(X, *[F.lit(None).cast("int")] * 3, F.lit("2024-01-01"), F.lit("f")), "PDF", "odt", "dwg", "zip", "weird", "") == ["pdf document", "odt document", "dwg cad model", "archive, not read", "weird captured 2024-01-01", "file captured 2024-01-01"]


def test_urls(spark):
    links_ = ["https://www.bbc.co.uk/x", "http://en.wikipedia.org:80/a", "techcrunch.com/a", "https://mp.weixin.qq.com/s", "https://u.medium.com", "https://unknown.io", "::bad::", "https://wired.com"]
    assert values(spark, urls.tier(X), *links_) == [1, 1, 2, 3, 4, 3, 3, 3]
    assert values(spark, urls.tier(X, ["www.wired.com"]), "https://wired.com", "https://HTTPS.wired.com/x") == [1, 1]
    assert values(spark, urls.registered_domain(X), *links_[:3]) == ["bbc.co.uk", "wikipedia.org", "techcrunch.com"]


def index_of(spark, *items):
    return spark.createDataFrame([(*i, k) for k, i in enumerate(items)], model.INDEX)


def test_four_way_lookup(spark):
    index = index_of(spark, ("/a", "1", "na"), ("/b", "2", "nb"), ("/a", "9", "na2"), ("/c", "2", "nc"), ("/u", "unknown", "nu"))
    files = spark.createDataFrame([("/a", "9"), ("/b", "7"), ("/new", "2"), ("/none", "5"), ("/v", "unknown")], "path string, fingerprint string")
    got = {r.path: tuple(r)[1:] for r in lookup.lookup(files, index).collect()}
    assert got == {"/a": ("skip", "na2", None), "/b": ("rescan", "nb", None), "/new": ("rename", "nc", "/c"), "/none": ("new", None, None), "/v": ("new", None, None)}


def test_diff_is_symmetric(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 1)], model.MANIFEST)
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 2), ("e", 1, 1)], model.MANIFEST)
    got = {r.path: r.change for r in lookup.diff(old, new).collect()}
    assert got == {"b": "modified", "c": "modified", "d": "removed", "e": "new"}
    swap = {"new": "removed", "removed": "new", "modified": "modified"}
    assert {r.path: swap[r.change] for r in lookup.diff(new, old).collect()} == got


def test_votes(spark):
    index = index_of(spark, *[(f"/old/P/f{k}", f"{k}", f"arch/P/n{k}.md") for k in range(4)], ("/x/Q/f", "9", "arch/Q/n.md"))
    sample = spark.createDataFrame([("P", k, str(k), "/new") for k in range(4)] + [("P", 5, "", "/new"), ("P", 6, "zz", "/new"), ("P2", 0, "0", "/new")], "folder string, ord int, fingerprint string, parent string")
    assert [tuple(r) for r in votes.moves(sample, index).collect()] == [("P", "/old", "/new", 4, 5, 0.8)]
    renamed = sample.where("folder = 'P'").withColumn("folder", F.lit("P new"))
    assert [tuple(r)[:4] for r in votes.renames(renamed, index, layout="domain").collect()] == [("P new", "P", 4, 5)]
    assert votes.renames(renamed, index, min_matches=5, layout="domain").count() == votes.renames(renamed, index, threshold=0.9, layout="domain").count() == 0


def test_duplicate_projects(spark):
    rows_ = [(f"/s/{p}{k}", f"{k}", f"d/{p}/2024-01-0{day_}.md") for p, ks, day_ in [("Ab", range(5), 1), ("Abc", range(4), 1), ("Xyz", range(1, 5), 2), ("Far", [8, 9, 10], 3)] for k in ks]
    index = index_of(spark, *rows_, ("/o", "1", "other/Ab/n.md"))
    got = {(r.canonical, r.alias): (r.overlap, round(r.confidence, 3)) for r in duplicates.duplicates(index, "d").collect()}
    assert got == {("Abc", "Ab"): (4, 0.8), ("Xyz", "Ab"): (4, 0.8), ("Xyz", "Abc"): (3, 0.6)}


def event_rows(spark, *items):
    rows_ = [("P", None if d is None else day(d), name, sub, None, hint, "", list(parties), k) for k, (d, name, sub, hint, parties) in enumerate(items)]
    return spark.createDataFrame(rows_, model.EVENT)


def test_islands(spark):
    events = event_rows(spark, *[(d, f"{d} x.md", "", "", []) for d in ("2024-01-01", "2024-01-08", "2024-01-16")], (None, "bad", "", "", []))
    got = sorted((r.folder, str(r.start), str(r.end), r.n_events) for r in clusters.clusters(events).collect())
    assert got == [("(root)", "2024-01-01", "2024-01-08", 2), ("(root)", "2024-01-16", "2024-01-16", 1)]


def test_labels(spark):
    events = event_rows(spark, ("2024-01-01", "2024-01-01 roof review.md", "A", "", []), ("2024-01-02", "2024-01-02 roof memo.md", "A", "", []), ("2024-01-01", "2024-01-01 施工图.md", "B", "", []), ("2024-01-01", "2024-01-01 one.md", "C", "", []), ("2024-01-02", "2024-01-02 two.md", "C", "", []))
    assert {r.folder: r.label for r in clusters.labels(events).collect()} == {"A": "roof ×2", "B": "施工图", "C": "one ×2"}


@pytest.mark.parametrize("days, kind", [(180, "active"), (181, "on-hold"), (730, "on-hold"), (731, "completed")])
def test_status(spark, days, kind):
    today = day("2024-08-01")
    events = event_rows(spark, (str(today - datetime.timedelta(days)), "n", "", "", ["b", "a"]), ("2000-01-01", "m", "", "", ["a", "c"]))
    got = clusters.status(events, today).first()
    assert got.status == kind and (got.timeline_end is not None) == (kind == "completed")
    assert clusters.parties(events).first().parties == "b, a, c"


def test_related_events(spark):
    events = event_rows(spark, ("2024-01-01", "roof plan", "SD", "", ["x"]), ("2024-01-01", "roof memo", "SD", "", ["x"]), ("2024-03-01", "other", "DD", "", []), ("2024-01-15", "roof", "CD", "", []))
    got = {(r.name, r.peer): r.score for r in links.pair_scores(events).collect()}
    assert got["roof plan", "roof memo"] == 14 and got["roof plan", "roof"] == 5 and not any("other" in k for k in got)
    shuffled = events.orderBy(F.desc("note_filename"))
    assert sorted(map(tuple, links.related(events).collect())) == sorted(map(tuple, links.related(shuffled).collect()))


def test_neighbours_and_orphans(spark):
    events = event_rows(spark, ("2024-01-02", "b", "S", "", []), ("2024-01-01", "a", "S", "", []), ("2024-01-02", "b", "S", "", []), ("2024-01-03", "c", "", "", []))
    assert {(r.name, r.prev, r.next) for r in links.neighbours(events).collect()} == {("a", None, "b"), ("b", "a", None)}
    notes = spark.createDataFrame([("a", "[[b]] [[a]]"), ("b", "none"), ("c", "[[ b]]")], "stem string, body string")
    assert {r.stem for r in links.orphans(notes).collect()} == {"a", "c"}
    bodies = spark.createDataFrame([("P", "a", "text"), ("P", "b", "Error: File x")], "project string, name string, body string")
    once = scan.linked_bodies(events, bodies)
    assert sorted(map(tuple, scan.linked_bodies(events, once).collect())) == sorted(map(tuple, once.collect()))


GOOD = {"schema_version": "2", "plugin": "p", "domain": "d", "project": "P", "source_path": "/a.pdf", "file_type": "pdf", "captured_date": "2024-01-01", "event_date": "2024-01-01", "event_date_source": "mtime", "scan_type": "retro", "sources_read": '["/a.pdf"]', "read_bytes": "5", "content_confidence": "high"}


@pytest.mark.parametrize(
    "change, first",
    [({}, None), ({"content_confidence": "low"}, None), ({"x": "1"}, "unknown-field"), ({"plugin": None}, "missing:plugin"), ({"read_bytes": "true"}, "type:read_bytes"), ({"tags": "no list"}, "type:tags"), ({"scan_type": "x"}, "enum:scan_type"), ({"schema_version": "9"}, "version"), ({"content_confidence": "metadata-only"}, "sources-without-confidence"), ({"sources_read": None}, "confidence-without-sources"), ({"sources_read": "[]", "content_confidence": "metadata-only"}, "bytes-without-sources"), ({"domain": "a/b"}, "domain-path"), ({"images_embedded": "2", "attachments": '["a"]'}, "images-without-attachments"), ({"image_captions": '["c"]'}, "captions-not-aligned")],
)
def test_violations(spark, change, first):
    fm = {k: v for k, v in (GOOD | change).items() if v is not None}
    notes = spark.createDataFrame([("n.md", fm)], "note_path string, fm map<string,string>")
    got = [r.violation for r in validate.violations(notes).orderBy("pos").collect()]
    assert (got[0] if got else None) == first


def test_index_notes_have_their_own_rules(spark):
    fm = {"schema_version": "2", "plugin": "p", "domain": "d", "project": "P", "note_type": model.INDEX_NOTE_TYPE, "status": "asleep", "timeline_start": "2024"}
    notes = spark.createDataFrame([("n.md", fm)], "note_path string, fm map<string,string>")
    assert [r.violation for r in validate.violations(notes).orderBy("pos").collect()] == ["enum:status", "date:timeline_start"]


def test_upgrade_is_idempotent(spark):
    schema = "note_path string, fm map<string,string>, body string, project string, domain string, mtime long"
    notes = spark.createDataFrame([("2024-02-03 memo.md", {"file_type": "odd"}, "NAS: `/x/y.docx`", "P", "d", 0), ("n.md", GOOD, "", "Q", "e", 86400)], schema)
    once = validate.upgrade(notes, "2024-08-01")
    row = once.where("note_path LIKE '2024%'").first()
    assert (row.source_path, row.file_type, row.event_date, row.event_date_source, row.content_confidence) == ("/x/y.docx", "docx", "2024-02-03", "filename-prefix", "metadata-only")
    names = [c for c in once.columns if c != "note_path"]
    again = once.select("note_path", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("string") for c in names])).alias("fm")).join(notes.drop("fm"), "note_path")
    assert sorted(map(tuple, validate.upgrade(again, "2024-08-01").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_domains_and_routes(spark):
    files = spark.createDataFrame([("/a/b/x",), ("/a/x",), ("/ab/x",), ("/z",)], "path string")
    domains = [("one", "/a"), ("two", "/a/b")]
    assert {r.path: r.domain for r in routing.domain_of(files, domains).collect()} == {"/a/b/x": "two", "/a/x": "one", "/ab/x": None, "/z": None}
    assert {r.domain for r in routing.domain_of(files, domains[:1]).collect()} == {"one"}
    named = spark.createDataFrame([("Meeting CD.pdf", ""), ("x", "Minutes of"), ("x", "")], "name string, text string")
    got = routing.route(named, [("cd", "CD"), ("meeting", "Meetings")], [("minutes", "Meetings")])
    assert sorted(r.subfolder for r in got.collect()) == ["Admin", "CD", "Meetings"]
    assert {r.subfolder for r in routing.route(named, [("cd", "CD")], mode="fallback").collect()} == {"Admin"}


def test_rows(spark):
    log = spark.createDataFrame([(f"{k}", "t", "", None, k) for k in range(201)], model.LOG)
    assert rows.newest(log, 200).count() == 200 and rows.newest(log, 0).count() == 201
    lines = "noise\n## 2024 | scan\na\nb\n## 2025 | move".split("\n")
    entries = rows.log_entries(spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, pos int, line string")).orderBy("entry").collect()
    assert [(e.header, e.body) for e in entries] == [("## 2024 | scan", "a\nb"), ("## 2025 | move", "")]
    images = spark.createDataFrame([("n", f"{k}", 20_000 if k % 2 else 5, str(k % 4), k) for k in range(30)], "note string, path string, size int, sha256 string, ord int")
    assert [r.ord for r in rows.images_to_embed(images).orderBy("ord").collect()] == [1, 3]
    samples = spark.createDataFrame([("a", 70_000, 1.0, 1), ("a", 140_000, 1.0, 2), ("a", 10, 1.0, 3), ("b", 1, 1.0, 1)], "archive string, size long, seconds double, ord int")
    assert {r.archive: (r.bytes_per_second, r.confidence) for r in rows.throughput(samples).collect()} == {"a": (105_000.0, "low"), "b": (1_048_576.0, "none")}


def test_research(spark):
    urls_ = ["https://reddit.com/a", "https://bbc.com/a", "https://www.bbc.com/b", *(f"https://u{k}.io" for k in range(8))]
    got = research.choose(spark.createDataFrame([(u, k) for k, u in enumerate(urls_)], "url string, ord int")).orderBy("tier", "ord").collect()
    assert [r.url for r in got] == ["https://bbc.com/a", "https://u0.io", "https://u1.io"]
    notes = spark.createDataFrame([("n", "![a](u1) ![b](u2 \"t\") ![c](u1)")], "note string, body string")
    assert [(r.url, r.k) for r in research.image_urls(notes).orderBy("k").collect()] == [("u1", 1), ("u2", 2)]


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_formats(spark, tmp_path):
    w, a = 'xmlns:w="w"', 'xmlns:a="a"'
    files = {
        "a.txt": "﻿hé".encode(), "b.txt": "中文".encode("gbk"), "c.docx": office(**{"word__document.xml": f"<w:d {w}><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:t>two</w:t></w:p></w:d>", "word__media__i.png": b"\x89PNG\r\n\x1a\n1"}),
        "d.pptx": office(**{f"ppt__slides__slide{k}.xml": f"<sld {a}><a:p><a:t>s{k}</a:t></a:p></sld>" for k in (10, 2)}),
        "e.xlsx": office(**{"xl__sharedStrings.xml": "<s><si><t>hi</t></si></s>", "xl__worksheets__sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>3</v></c></row></w>'}),
        "f.docx": b"broken", "g.xyz": b"?",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / ".skip").mkdir()
    (tmp_path / ".skip" / "h.txt").write_bytes(b"no")
    listed = archive.listing(spark, f"file://{tmp_path}", [".*"], content=True)
    got = {r.path.rsplit("/", 1)[1]: r for r in formats.extract_text(listed).collect()}
    assert {k: r.text for k, r in got.items()} == {"a.txt": "hé", "b.txt": "中文", "c.docx": "one\ntwo", "d.pptx": "s2\ns10", "e.xlsx": "hi\t3", "f.docx": "", "g.xyz": ""}
    assert got["f.docx"].error and got["g.xyz"].error == "no reader" and got["a.txt"].error is None
    images = formats.extract_images(listed.where("path LIKE '%.docx'")).collect()
    assert [(r.name, r.kind) for r in images if r.error is None] == [("i.png", "png")] and [r.path.rsplit("/", 1)[1] for r in images if r.error] == ["f.docx"]


def test_tables_of_tabs_and_notes(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("/a\t1\tn\n\nbad\tx\n/b\t2\t\n")
    good, bad = archive.tab_rows(spark, f"file://{tmp_path}/i.tsv", ["source_path", "fingerprint", "note_path"])
    assert [tuple(r) for r in good.orderBy("ord").collect()] == [("/a", "1", "n", 0), ("/b", "2", "", 3)] and bad.count() == 1
    (tmp_path / "n.md").write_text("---\nproject: P\n---\nbody")
    note = archive.notes(spark, f"file://{tmp_path}").first()
    assert (note.fence, note.body) == ("project: P", "body")


def test_scores(spark):
    pair = lambda f: values(spark, f(A.cast("date"), B.cast("date")), ("2024-01-01", "2024-01-01"), ("2024-01-01", "2024-01-04"), ("2024-01-05", "2024-01-01"), ("2024-01-01", None), ("2024-01-01", "2024-01-15"))
    assert pair(dates.short_proximity) == [10, 7, 0, 0, 0]
    assert [round(x, 3) for x in pair(dates.long_proximity)] == [4, 3.143, 2.857, 0, 0]
    assert values(spark, scoring.sha_prefix(X), "abc") == ["ba7816bf8f01cfea"]


def test_stream_of_listings(spark, tmp_path):
    source, index = tmp_path / "in", f"file://{tmp_path}/index"
    seen = {}
    schema = "path string, fingerprint string"

    def poll(n, rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(schema).parquet(f"file://{source}")
        deltas.start(stream, index, f"file://{tmp_path}/check", lambda d, b: seen.update({n: sorted((r.path, r.action) for r in d.collect())})).awaitTermination()

    poll(0, [("/a", "1"), ("/b", "2")])
    poll(1, [("/a", "1"), ("/b", "3"), ("/c", "1")])
    assert seen == {0: [("/a", "new"), ("/b", "new")], 1: [("/a", "skip"), ("/b", "rescan"), ("/c", "rename")]}
    assert deltas.index_table(spark, index).count() == 4


def test_scan(spark):
    files = spark.createDataFrame([("/r/P/2024-01-02 a.txt", 3, 0, "1", "abc"), ("/r/P/b.mov", 3, 86400, "2", ""), ("/r/P/c.txt", 0, 0, "3", ""), ("/r/P/old.txt", 1, 0, "4", "x"), ("/r/.x/a.txt", 1, 0, "5", "x")], "path string, size long, mtime long, fingerprint string, text string")
    got = {r.path: r for r in scan.scan(files, index_of(spark, ("/r/P/old.txt", "4", "n")), [".*"]).collect()}
    assert set(got) == {"/r/P/2024-01-02 a.txt", "/r/P/b.mov", "/r/P/c.txt"}
    assert (got["/r/P/2024-01-02 a.txt"].event_date, got["/r/P/2024-01-02 a.txt"].skip_reason) == (day("2024-01-02"), None)
    assert [got[p].skip_reason for p in ("/r/P/b.mov", "/r/P/c.txt")] == ["video", "no_content"]
