"""Files written one by one, index files read in splits, snapshots found by their names."""

import hashlib
import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliary import model
from foliary.sources import archive, note_files, writers

FIELDS = ["source_path", "fingerprint", "note_path"]


def files_below(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names if note_files.PENDING not in d}


def test_write_and_read_back(spark, tmp_path):
    texts = {"a/b c.md": "hé\n", "x#y%20.md": "", "z.md": None, "k?m.md": "kk", "ü/日.md": "日本"}
    rows = spark.createDataFrame([*texts.items(), (None, "q")], "path string, text string").repartition(3)
    root = f"file://{tmp_path}/out"
    got = {r.path: r for r in note_files.write_acknowledged(rows, root).collect()}
    want = {k: (v or "").encode() for k, v in texts.items()}
    assert files_below(tmp_path / "out") == want
    assert {k: (r.bytes_written, r.sha256, r.ok, r.error) for k, r in got.items()} == {k: (len(v), hashlib.sha256(v).hexdigest(), True, None) for k, v in want.items()}
    read = {r.path: bytes(r.content) for r in note_files.read(spark, root).collect()}
    assert read == {k: v for k, v in want.items() if v}


def test_errors_are_rows(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    note_files.write(spark.createDataFrame([("a", "1")], "path string, text string"), root)
    os.mkdir(tmp_path / "out" / "folder")
    asked = spark.createDataFrame([("a", "x"), ("none", None), ("folder", None)], "path string, expected string")
    got = {r.path: (r.ok, r.error) for r in note_files.acknowledged(asked, root).collect()}
    assert got["a"] == (False, "another digest than expected") and got["none"] == (False, "not written") and got["folder"][0] is False


def test_create_keeps_and_overwrite_replaces(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = lambda text: spark.createDataFrame([("a", text), ("b", text)], "path string, text string")
    note_files.write(rows("1").where("path = 'a'"), root)
    note_files.write(rows("2"), root)
    assert files_below(tmp_path / "out") == {"a": b"1", "b": b"2"}
    before = os.stat(tmp_path / "out" / "b").st_mtime_ns
    note_files.write(rows("2"), root, overwrite=True)
    assert files_below(tmp_path / "out") == {"a": b"2", "b": b"2"} and os.stat(tmp_path / "out" / "b").st_mtime_ns == before  # equal bytes aren't written again


@pytest.mark.parametrize("path", ["../x", "/etc/x", "a/../../x", ".", "_pending/x"])
def test_paths_stay_below_the_root(spark, tmp_path, path):
    rows = spark.createDataFrame([("good", "1"), (path, "2")], "path string, text string")
    with pytest.raises(PySparkException, match="not a path below the root"):
        note_files.write(rows, f"file://{tmp_path}/out")
    assert files_below(tmp_path / "out") == {}


def test_files_in_parts(spark, tmp_path):
    """One file of 50,000 parts, which no row holds whole."""
    rows = spark.range(50_000).select(F.lit("big.md").alias("path"), F.col("id").alias("part"), F.concat(F.lit("line "), F.col("id").cast("string"), F.lit("\n")).alias("text"))
    rows = rows.union(spark.createDataFrame([("s.md", 2, "b"), ("s.md", 1, "a")], "path string, part long, text string")).repartition(5)
    note_files.write(rows, f"file://{tmp_path}/out")
    got = files_below(tmp_path / "out")
    assert got["big.md"].decode().split("\n")[:-1] == [f"line {k}" for k in range(50_000)] and got["s.md"] == b"ab"


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("n"), "id").alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("string").alias("text")).repartition(4)
    with pytest.raises(PySparkException):
        note_files.write(rows, f"file://{tmp_path}/out")
    assert files_below(tmp_path / "out") == {}


def test_sections_are_appended(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    note_files.write(spark.createDataFrame([("a.md", "text\n\n"), ("b.md", "other")], "path string, text string"), root)
    missing = note_files.append_sections(spark.createDataFrame([("a.md", "## More"), ("c.md", "x"), ("b.md", None)], "path string, section string"), root)
    assert [r.path for r in missing.collect()] == ["c.md"]
    assert files_below(tmp_path / "out") == {"a.md": b"text\n\n## More\n", "b.md": b"other"}


KILLED = """
import sys, time
from pyspark.sql import SparkSession, functions as F
from foliary.sources import note_files
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
@F.udf("string")
def slow(k):
    time.sleep(0.02)
    return f"note {k} " * 1000
rows = spark.range(400).repartition(8).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".md")).alias("path"), slow("id").alias("text"))
note_files.write(rows, sys.argv[1])
"""


def test_killed_in_the_middle_and_run_again(spark, tmp_path):
    root = tmp_path / "out"
    env = os.environ | {"PYTHONPATH": os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])}
    run = subprocess.Popen([sys.executable, "-c", KILLED, f"file://{root}"], env=env, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    for _ in range(600):
        time.sleep(0.1)
        if sum(len(f) for _, _, f in os.walk(root)) > 20:
            break
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    assert files_below(root) == {} and sum(len(f) for _, _, f in os.walk(root)) > 0  # pending ones only
    note_files.sweep(f"file://{root}")
    rows = spark.range(400).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.repeat(F.concat(F.lit("note "), F.col("id").cast("string"), F.lit(" ")), F.lit(1000)).alias("text"))
    note_files.write(rows, f"file://{root}")
    assert files_below(root) == {f"n{k}.md": (f"note {k} " * 1000).encode() for k in range(400)}


def whole_file_read(path):
    """What the rows are if a file is read whole."""
    good, bad = [], []
    for k, line in enumerate(open(path, newline="").read().replace("\r\n", "\n").split("\n")):
        fields = line.split("\t")
        if line.strip(" "):
            (good if len(fields) == 3 else bad).append((*fields, k) if len(fields) == 3 else (k, line))
    return good, bad


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ["1024", "0"], strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_index_in_splits(spark, tmp_path, small_splits):
    lines = [f"/päth/{k}\tfp{k}\tn{k}" + ("\r" if k % 7 == 0 else "") if k % 50 else ("" if k % 100 else f"bad {k}\tx") for k in range(3000)]
    (tmp_path / "i.tsv").write_text("\n".join(lines))
    rows = archive.numbered_lines(spark, f"file://{tmp_path}/i.tsv")
    assert spark.read.option("lineSep", "\n").text(f"file://{tmp_path}/i.tsv").rdd.getNumPartitions() > 20
    good, bad = archive.tab_rows(spark, f"file://{tmp_path}/i.tsv", FIELDS)
    want = whole_file_read(tmp_path / "i.tsv")
    assert rows.count() == 3000
    assert sorted((tuple(r) for r in good.collect()), key=lambda r: r[3]) == want[0]
    assert sorted((r.ord, r.line) for r in bad.collect()) == want[1]


@pytest.mark.parametrize("across", [False, True])
def test_several_files(spark, tmp_path, small_splits, across):
    os.mkdir(tmp_path / "d")
    for name, n in (("a", 700), ("b", 0), ("c", 1), ("d", 900)):
        (tmp_path / "d" / f"{name}.tsv").write_text("".join(f"{name}\t{k}\tx\n" for k in range(n)))
    good, bad = archive.tab_rows(spark, f"file://{tmp_path}/d", FIELDS, across=across)
    start = {"a": 0, "c": 700, "d": 701} if across else dict.fromkeys("acd", 0)
    assert sorted((r.ord - start[r.source_path], r.source_path) for r in good.collect()) == sorted((k, name) for name, n in (("a", 700), ("c", 1), ("d", 900)) for k in range(n))
    assert bad.count() == 0


def test_comments_and_further_fields(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("# sha\tname\nh1\ta.png\tmore\n\nh2\tb.png\nh3\n")
    good, bad = archive.tab_rows(spark, f"file://{tmp_path}/i.tsv", ["sha256", "filename"], comment="#", more=True)
    assert sorted(tuple(r) for r in good.collect()) == [("h1", "a.png", 1), ("h2", "b.png", 3)] and [(r.ord, r.line) for r in bad.collect()] == [(4, "h3")]


def test_newest_of_a_thousand_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/m"
    writers.write_manifest(spark.createDataFrame([("/old", 1, 1)], model.MANIFEST), root, 1000)
    for k in range(1, 1000):
        os.mkdir(tmp_path / "m" / f"snapshot={k}")
        (tmp_path / "m" / f"snapshot={k}" / "_SUCCESS").touch()
        (tmp_path / "m" / f"snapshot={k}" / "part-0.parquet").write_bytes(b"not to be read")
    os.mkdir(tmp_path / "m" / "snapshot=2000")  # not written whole
    got = writers.newest_manifest(spark, root)
    assert {f.rsplit("/", 2)[1] for f in got.inputFiles()} == {"snapshot=1000"}
    assert [tuple(r) for r in got.collect()] == [("/old", 1, 1, 1000)]
    assert writers.newest_manifest(spark, root, before=1).collect() == []
    assert len(writers.prune_manifests(spark, root, keep=3)) == 997
    assert sorted(writers.snapshots(spark, root)) == [998, 999, 1000]
