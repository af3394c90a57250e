"""Frontmatter against a YAML library, and notes judged from their text."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from foliary.functions import frontmatter
from foliary.operators import validate

PLAIN = ["alpha", "beta gamma", "a:b", "http://x.y/z?a=1", "2024-01-05", "12", "-7", "1_000", "0x1F", "017", "0b11", "12:30:45", "yes", "No", "null", "~", "3.5", "1e3", ".5", "+1.5e+3", "日本 語", "it's fine", 'say "hi" now', "x#y", "v1.2.3", "2024-01-05 10:20:30"]
QUOTED = ["alpha", "béta gamma", "it's", "x # y", "a:b", "10%", "C&D", "one, two", "2024-01-05", "12", "yes", "null", "", "日本", "tab\there", 'q"uote', "-dash", "back\\slash", "bell\x07"]


def odd_fence(r):
    double = lambda: json.dumps(r.choice(QUOTED), ensure_ascii=r.random() < 0.5)
    single = lambda: "'" + r.choice(QUOTED).replace("'", "''").replace("\t", " ").replace("\x07", "") + "'"
    item = lambda: r.choice([lambda: r.choice(PLAIN), double, single])()
    scalar = lambda: r.choice([lambda: r.choice(PLAIN), item])()
    remark = lambda: r.choice([""] * 5 + ["  # note", " # it's a \"c\""])

    def value():
        k = r.randrange(13)
        if k < 3:
            return " " + scalar() + remark()
        if k == 3:
            return remark()
        if k == 4:
            return " [" + ", ".join(item() for _ in range(r.randrange(4))) + "]" + remark()
        if k in (5, 6):
            indent = r.choice(["", "  ", "    "])
            return remark() + "".join("\n" + r.choice([""] * 6 + [indent + "# c\n", "\n"]) + indent + "- " + scalar() + remark() for _ in range(r.randrange(1, 4)))
        if k == 7:
            return " |" + r.choice(["", "-", "+"]) + "\n  line one\n  line: two\n\n    # deeper\n  end" + r.choice(["", "\n", "\n\n"])
        if k == 8:
            return " >" + r.choice(["", "-"]) + "\n  one\n  two\n\n  three # x" + r.choice(["", "\n"])
        if k == 9:
            return " first line\n  second line\n  third" + remark()
        if k == 10:
            return "\n  a: " + scalar() + "\n  b: " + item()
        if k == 11:
            return ' "two\n  lines\n\n  here"'
        return " [\n  " + ",\n  ".join(item() for _ in range(r.randrange(1, 4))) + "\n  ]"

    keys = ["title", "tags", "x_y", "a b", "date", "n", "über", "'q k'", '"d\\"k"', "list", "sub-key"]
    r.shuffle(keys)
    out = []
    for k in keys[: r.randrange(1, 7)]:
        if r.random() < 0.15:
            out.append(r.choice(["# comment: x", "", "  # indented"]))
        out.append(k + ":" + value())
    if r.random() < 0.1:
        out.append(keys[0] + ": again")
    return r.choice(["\n", "\n", "\r\n"]).join("\n".join(out).split("\n"))


def canonical(v):
    if v is None:
        return ("null", None)
    for kind, name, text in ((bool, "bool", lambda x: str(x).lower()), (int, "int", str), (float, "float", float), (datetime.date, "date", lambda x: x), (str, "str", str)):
        if isinstance(v, kind):
            return (name, text(v))
    if isinstance(v, list):
        return ("list", [canonical(x)[1] for x in v])
    return ("map", {canonical(k)[1]: canonical(x)[1] for k, x in v.items()})


def alike(got, want):
    if isinstance(want, float):
        return got is not None and float(got.replace("_", "")) == want
    if isinstance(want, datetime.datetime):
        return got == want.strftime("%Y-%m-%d %H:%M:%S")
    return got == (want.isoformat() if isinstance(want, datetime.date) else want)


def same(kind, value, want):
    if kind != want[0]:
        return False
    if kind == "list":
        own = json.loads(value)
        return len(own) == len(want[1]) and all(map(alike, own, want[1]))
    if kind == "map":
        own = json.loads(value)
        return set(own) == set(want[1]) and all(alike(own[k], want[1][k]) for k in own)
    return alike(value, want[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_a_yaml_library(spark, seed):
    yaml = pytest.importorskip("yaml")
    r, fences = random.Random(seed), []
    while len(fences) < 1000:
        fence = odd_fence(r)
        try:
            read = yaml.safe_load(fence)
        except (yaml.YAMLError, ValueError):
            continue
        if isinstance(read, dict):
            fences.append((len(fences), fence, read))
    rows = spark.createDataFrame([x[:2] for x in fences], "i int, fence string").withColumn("p", frontmatter.parsed(F.col("fence")))
    rows = rows.select("i", frontmatter.by_key(F.col("p"), "value").alias("v"), frontmatter.by_key(F.col("p"), "kind").alias("k"), frontmatter.well_formed(F.col("p")).alias("ok"))
    for row in rows.collect():
        want = {canonical(k)[1]: canonical(v) for k, v in fences[row.i][2].items()}
        assert row.ok and set(want) == set(row.v), fences[row.i]
        assert all(same(row.k[k], row.v[k], want[k]) for k in want), fences[row.i]


@pytest.mark.parametrize("fence", ["a: [1, 2", 'a: "x', "a: 'x", "a: b: c", "- a\n- b", "plain text", "", "a: {b: 1", "a: @x"])
def test_malformed(spark, fence):
    rows = spark.createDataFrame([(fence,)], "f string").select(frontmatter.well_formed(frontmatter.parsed(F.col("f"))).alias("ok"))
    assert rows.first().ok is False


def test_fences(spark):
    notes = {"---\na: 1\n---\nbody\n---\nb": ("a: 1\n", "body\n---\nb"), "---\n---\nx": ("", "x"), "﻿---\r\na: 1\r\n---\r\nx": ("a: 1\r\n", "x"), "no\n---\na\n---\n": (None, "no\n---\na\n---\n"), "---\na: 1": (None, "---\na: 1"), "----\na\n----\n": (None, "----\na\n----\n")}
    rows = spark.createDataFrame([(k,) for k in notes], "n string").select("n", frontmatter.fence_of(F.col("n")).alias("f"), frontmatter.body_of(F.col("n")).alias("b"))
    assert {r.n: (r.f, r.b) for r in rows.collect()} == notes


def test_long_fences_are_read_in_proportion(spark):
    """100,000 list items, keys and escapes: no step looks at every pair, and no pattern overflows its stack."""
    fence = "tags:\n" + "".join(f"- tag {k}\n" for k in range(100_000)) + 'said: "' + "a\\n" * 50_000 + '"\n' + "".join(f"k{k}: {k}\n" for k in range(10_000))
    rows = spark.createDataFrame([(fence,)], "f string").withColumn("p", frontmatter.parsed(F.col("f"))).select(F.size("p").alias("n"), F.json_array_length(F.col("p")[0]["value"]).alias("items"), F.char_length(F.col("p")[1]["value"]).alias("said"))
    assert tuple(rows.first()) == (10_002, 100_000, 100_000)


VALID = "schema_version: 2\nplugin: kit\ndomain: arch\nproject: P\nsource_path: /a\nfile_type: pdf\ncaptured_date: 2024-01-01\nevent_date: 2024-01-01\nevent_date_source: mtime\nscan_type: retro\nsources_read: [a]\nread_bytes: 10\ncontent_confidence: high\n"
INDEX = "schema_version: 2\nplugin: kit\ndomain: arch\nproject: P\nnote_type: project-index\nstatus: active\nparties:\n- one\n- two\n"


@pytest.mark.parametrize(
    "text, codes",
    [
        (f"---\n{VALID}---\nbody", []),
        (f"---\n{VALID}attachments:\n  - '2024--a.jpg'\ncssclasses: [grid]\nimages_embedded: 1\n---\n", []),
        (f"---\n{VALID.replace('content_confidence: high', 'content_type: full')}---\n", ["unknown-field", "missing:content_confidence", "sources-without-confidence"]),
        (f"---\n{VALID.replace('read_bytes: 10', 'read_bytes: true')}---\n", ["type:read_bytes"]),
        (f"---\n{VALID.replace('read_bytes: 10', 'read_bytes: \"10\"')}---\n", ["type:read_bytes"]),
        (f"---\n{VALID.replace('sources_read: [a]', 'sources_read: a')}---\n", ["type:sources_read", "confidence-without-sources", "bytes-without-sources"]),
        (f"---\n{VALID.replace('project: P', 'project: 12')}---\n", ["type:project"]),
        (f"---\n{VALID.replace('project: P', 'project:')}---\n", ["type:project"]),
        (f"---\n{VALID.replace('schema_version: 2', 'schema_version: \"2\"')}---\n", ["version", "type:schema_version"]),
        (f"---\n{VALID.replace('plugin: kit', 'plugin: x')}---\n", ["literal:plugin"]),
        (f"---\n{VALID.replace('schema_version: 2', 'schema_version: 1')}---\n", ["unknown-field", "missing:cssclasses"]),
        (f"---\n{VALID.replace('schema_version: 2', 'schema_version: 1').replace('domain: arch', 'cssclasses: []')}---\n", []),
        (f"---\n{INDEX}---\n", []),
        (f"---\n{INDEX.replace('parties:\n- one\n- two', 'parties: one')}---\n", ["type:parties"]),
        (f"---\n{INDEX.replace('active', 'gone')}timeline_start: soon\n---\n", ["enum:status", "date:timeline_start"]),
        ("---\na: [\n---\n", ["malformed"]),
        ("body only", ["no-frontmatter"]),
    ],
)
def test_violations_of_text(spark, text, codes):
    got = validate.violations_of_text(spark.createDataFrame([("n", text)], "note_path string, text string"), plugin="kit")
    assert [r.violation for r in got.orderBy("pos").collect()] == codes
