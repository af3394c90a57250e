"""Operators that pair rows under selective keys, against all pairs; and pages, reports and index rows."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from foliary.operators import audit, duplicates, links, lookup, pages, reports, templates, votes
from foliary.plans import scan

EVENT = "project string, note_filename string, subfolder string, event_date date, ord long, summary_hint string, parties array<string>, fallback_hint string"


def some_events(spark, n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        day = None if r.random() < 0.1 else datetime.date(2024, 1, 1) + datetime.timedelta(days=r.randrange(60))
        words = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "plan", "note"]) for _ in range(r.randrange(3)))
        rows.append((r.choice(["p", "q"]), r.choice(["", f"n{k} x{k}", f"m{k} y{k}"]), r.choice(["", "SD", "CD"]), day, k, words if r.random() < 0.3 else "", r.sample("ABCDEF", r.randrange(4)), ""))
    return spark.createDataFrame(rows, EVENT), rows


def test_pairs_meet_under_their_keys(spark):
    df, rows = some_events(spark, 160, 1)
    got = {(r.project, r.name, r.peer): r.score for r in links.pair_scores(df).collect()}
    from foliary.functions import text

    token_rows = df.select("ord", F.array_distinct(F.concat(text.tokens(F.col("note_filename")), text.tokens(F.col("summary_hint")))).alias("t")).collect()
    tokens = {r.ord: set(r.t) for r in token_rows}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] and b[1] and a[1] != b[1]:
                days = abs((a[3] - b[3]).days) if a[3] and b[3] else None
                score = 5 * min(3, len(tokens[a[4]] & tokens[b[4]])) + 3 * (a[2] != "" and a[2] == b[2]) + 2 * min(3, len(set(a[6]) & set(b[6])))
                score += 4 * (1 - days / 14) if days is not None and days <= 14 else 0
                if score >= 4:
                    want[a[0], a[1], b[1]] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 500


def test_a_project_of_many_events(spark):
    """20,000 events of one project: 400 million pairs, of which few share a key."""
    df = spark.range(20_000).selectExpr(
        "'p' AS project", "concat('n', id, ' x', id) AS note_filename", "concat('s', id % 500) AS subfolder", "date_add(DATE '2000-01-01', cast(id * 37 % 20011 AS int)) AS event_date",
        "id AS ord", "'' AS summary_hint", "array(concat('p', id % 700)) AS parties", "'' AS fallback_hint",
    )
    began = time.time()
    assert links.pair_scores(df).count() < 200_000 and time.time() - began < 120
    notes = df.selectExpr("project", "event_date", "'dwg' AS file_type", "concat('/a/b', ord % 9, '/f') AS source_path", "note_filename AS vault_path")
    began = time.time()
    assert links.candidates(notes, notes).count() == 20_000 * 20 and time.time() - began < 120


@pytest.mark.parametrize("k", [1, 3, 20])
def test_candidates_against_all_pairs(spark, k):
    r = random.Random(k)
    rows = []
    for j in range(150):
        day = None if r.random() < 0.2 else datetime.date(2024, 1, 1) + datetime.timedelta(days=r.randrange(12))
        rows.append((r.choice("pq"), day, r.choice(["dwg", "pdf"]), r.choice(["/a/b/x", "/a/c/y", "/z", "", None]), f"v{r.randrange(120):03d}"))
    df = spark.createDataFrame(rows, "project string, event_date date, file_type string, source_path string, vault_path string")
    orphan = rows[::10]
    own = spark.createDataFrame(orphan, df.schema).dropDuplicates(["vault_path"])
    kept = {x.vault_path: tuple(x) for x in own.collect()}
    got = {(x.orphan, x.candidate): (x.score, x["rank"]) for x in links.candidates(own, df, k).collect()}
    lead = lambda p: [s for s in (p or "").split("/") if s]
    want = {}
    for path, a in kept.items():
        best = {}
        for b in rows:
            if a[0] != b[0] or b[4] == path:
                continue
            days = abs((a[1] - b[1]).days) if a[1] and b[1] else 99
            x, y = lead(a[3]), lead(b[3])
            same = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))  # noqa: B905
            score = 3.0 + ({0: 10, 1: 9, 2: 8, 3: 7}.get(days, 0)) + (a[2] == "dwg" and same - 1 > 0)
            best[b[4]] = max(score, best.get(b[4], 0))
        for rank, (candidate, score) in enumerate(sorted(best.items(), key=lambda c: (-c[1], c[0]))[:k], 1):
            want[path, candidate] = (score, rank)
    assert got == want


@pytest.mark.parametrize("least, confidence", [(1, 0.0), (3, 0.6), (2, 0.3)])
def test_duplicate_projects_against_all_pairs(spark, least, confidence):
    r = random.Random(least)
    rows, sets = [], {}
    for p in range(40):
        base = [f"f{p % 8}-{k}" for k in range(12)]
        own = {f for f in base if r.random() < 0.8} | {"hot"} | {f"z{r.randrange(300)}" for _ in range(3)}
        sets[f"proj{p:02d}"] = own
        rows += [(f"/a/{p}/{f}", f, f"d/proj{p:02d}/s/2024-01-{1 + p % 28:02d} {f}.md", k) for k, f in enumerate(sorted(own))]
    index = spark.createDataFrame(rows, "source_path string, fingerprint string, note_path string, ord long")
    got = {tuple(sorted((x.canonical, x.alias))): x.overlap for x in duplicates.duplicates(index, "d", least, confidence).collect()}
    want = {}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n >= least and n / len(sets[a] | sets[b]) >= confidence:
                want[a, b] = n
    assert got == want and want


def test_every_index_row_has_an_ord_of_its_own(spark):
    index = spark.createDataFrame([("/a/same", "f0", "d/p/n0.md", 0), ("/a/changed", "old", "d/p/n1.md", 1), ("/a/before", "f2", "d/p/n2.md", 2)], "source_path string, fingerprint string, note_path string, ord long")
    files = spark.createDataFrame([("/a/same", "f0"), ("/a/changed", "new"), ("/a/after", "f2"), *[(f"/a/x{k}", f"g{k % 40}") for k in range(300)]], "path string, fingerprint string")
    new = lookup.merge(index, lookup.lookup(files, index), files, 2)
    rows = new.collect()
    assert sorted(r.ord for r in rows) == list(range(3, 3 + 302))
    both = index.unionByName(new)
    assert {r.path: r.action for r in lookup.lookup(files, both).collect()} == {p: "skip" for p, _ in files.collect()}


def test_equal_ords_are_decided_by_path(spark):
    rows = [("/b", "f", "n1", 5), ("/a", "f", "n2", 5), ("/c", "g", "n3", 1)]
    index = spark.createDataFrame(rows, "source_path string, fingerprint string, note_path string, ord long")
    assert {r.fingerprint: r.source_path for r in lookup.last_by(index, "fingerprint").collect()} == {"f": "/b", "g": "/c"}


def test_pages_keep_what_users_wrote(spark):
    marked = "---\nproject: p\n---\nmine\n\n<!-- auto-start -->\nold\n## Status\nx\n<!-- auto-end -->\n\n## After\nkept\n"
    plain = "# T\n> [!abstract] Overview\n> said\n>more\n\n## Budget\n10\n\n## Status\ngone\n\n## Own words\n\ntext\n### sub\n"
    old = spark.createDataFrame([("a", marked), ("b", plain), ("c", None), ("d", "")], "project string, page string")
    found = {r.project: r for r in pages.existing(old).collect()}
    assert found["a"].marker_head == "mine" and found["a"].marker_tail == "## After\nkept\n" and found["a"].has_markers
    assert found["a"].frontmatter == {"project": "p"} and found["b"].frontmatter == {}
    assert (found["b"].overview, found["b"].budget, found["b"].user_sections) == ("said\nmore", "10", "## Own words\ntext\n### sub")
    assert found["c"].user_sections == found["d"].overview == "" and not found["c"].has_markers
    fresh = spark.createDataFrame([(x, "new") for x in "abce"], "project string, page string")
    block = "<!-- auto-start -->\nnew\n<!-- auto-end -->"
    once = pages.regenerated(fresh, old)
    got = {r.project: r.page for r in once.collect()}
    assert got["a"] == f"mine\n\n{block}\n\n## After\nkept\n"
    assert got["b"] == f"> [!abstract] Overview\n> said\n> more\n\n{block}\n\n## Budget\n\n10\n\n## Own words\ntext\n### sub"
    assert got["c"] == got["e"] == block
    again = {r.project: r.page for r in pages.regenerated(fresh, once).collect()}
    assert again == got


def test_pages_of_an_index(spark):
    rows = [("/s/1", "f1", "d/p/SD/2024-01-02 one.md", 1), ("/s/2", "f2", "d/p/CD/2024-01-05 two.md", 2), ("/s/3", "f3", "d/q/none.md", 3), ("/s/4", "f4", "", 4), ("/s/5", "f5", "d/p/SD/2024-01-02 one.md", 5)]
    index = spark.createDataFrame(rows, "source_path string, fingerprint string, note_path string, ord long")
    events = pages.events_of_index(index)
    got = sorted((r.project, r.subfolder, str(r.event_date), r.note_filename, r.ord) for r in events.collect())
    assert got == [("p", "CD", "2024-01-05", "2024-01-05 two", 2), ("p", "SD", "2024-01-02", "2024-01-02 one", 5), ("q", "", "None", "none", 3)]
    made = {r.project: r.page for r in scan.project_pages(events, datetime.date(2024, 8, 1)).collect()}
    assert "2024-01-05 two" in made["p"] and made["p"].index("# p") < made["p"].index("## Substructures") and set(made) == {"p", "q"}
    tasks = {r.project: r for r in pages.compose_tasks(events, spark.createDataFrame([("p", "## Budget\n7")], "project string, page string")).collect()}
    assert tasks["p"].notes == ["2024-01-02 one", "2024-01-05 two"] and tasks["p"].subfolders == ["CD", "SD"] and tasks["p"].preserved == {"Budget": "7"}


def test_moved_notes_are_repaired(spark):
    rows = [("/old/p/a", "f", "d/p/n1.md", 1), ("/old/px/a", "f", "d/p/n2.md", 2), ("/old/q/a", "f", "d/q/n3.md", 3), ("/old/p", "f", "d/p/n4.md", 4)]
    index = spark.createDataFrame(rows, "source_path string, fingerprint string, note_path string, ord long")
    moved = spark.createDataFrame([("p", "/old/", "/new")], "folder string, old_parent string, new_parent string")
    assert {r.note_path: r.source_path for r in votes.repairs(moved, index).collect()} == {"d/p/n1.md": "/new/p/a", "d/p/n4.md": "/new/p"}
    assert [r.note_path for r in votes.project_notes(index, "d/q").collect()] == ["d/q/n3.md"]


def test_tallies_and_lists(spark):
    found = spark.createDataFrame([("orphan", "n", ""), ("orphan", "m", "")], "check string, note string, detail string")
    assert {r.check: r.n for r in reports.check_counts(found, audit.CHECKS).collect()} == {c: 2 if c == "orphan" else 0 for c in audit.CHECKS}
    rows = spark.createDataFrame([("a", k, f"v{k}") for k in range(12)] + [("b", 0, "w")], "key string, ord int, value string")
    assert {r.key: (len(r.listed), r.more) for r in reports.first_of(rows, "key", F.col("value"), 10).collect()} == {"a": (10, 2), "b": (1, 0)}
    log = spark.createDataFrame([(k, "t", "scan" if k % 2 else "skip", f"s{k}", None) for k in range(5)], "ord long, timestamp string, type string, summary string, details string")
    body = reports.log_text(log, 2).first().body
    assert body == "## Counters\n\n- scan: 1\n- skip: 1\n\n## Entries\n\n- **t** · `skip` · s4\n- **t** · `scan` · s3"
    packages = spark.createDataFrame([("a", [["2024-01-02T01", "2024-03-01T00"], []]), ("b", [])], "package string, releases array<array<string>>")
    assert {r.package: r.last_release for r in templates.last_release(packages).collect()} == {"a": "2024-03-01", "b": ""}
