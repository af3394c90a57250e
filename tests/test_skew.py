"""Operators on very large projects and files: the same rows as by plain windows and all pairs, without any task that has all of them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary import model
from foliary.operators import clusters, detect, links, pages, rows

DAY = datetime.date(2024, 1, 1)


def event(project, day, name, folder="a", parties=(), ord_=0, hint=""):
    return (project, None if day is None else DAY + datetime.timedelta(day), name, folder, "high", hint, "", list(parties), ord_)


def frame(spark, own):
    return spark.createDataFrame(own, model.EVENT).repartition(3)


def random_events(n, seed=0, projects=("p", "q", None)):
    r = random.Random(seed)
    return [event(r.choice(projects), r.choice([None, *range(60)]) if r.random() < 0.5 else r.randrange(400), f"2024-01-01 {r.choice(['click', 'view', 'buy'])} {r.choice(['alpha', 'beta', ''])}-{r.randrange(n)}", r.choice(["a", "b", "", None]), r.sample(["x", "y", "z", "w"], r.randrange(4)), k, r.choice(["", "gamma", "gamma delta"])) for k in range(n)]


def said(df):
    return sorted(map(str, df.collect()))


def test_islands_as_by_a_window_over_all_events(spark):
    events = frame(spark, random_events(600))
    dated = events.where("event_date IS NOT NULL").withColumn("folder", F.coalesce(F.nullif(F.col("subfolder"), F.lit("")), F.lit("(root)")))
    order = Window.partitionBy("project", "folder").orderBy("event_date", "note_filename", "ord")
    gap = F.datediff("event_date", F.lag("event_date").over(order)) > 3
    want = dated.withColumn("island", F.sum(F.when(gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    assert said(clusters.islands(events, 3).select(sorted(want.columns))) == said(want.select(sorted(want.columns)))
    grouped = want.groupBy("project", "folder", "island").agg(F.min("event_date").alias("start"), F.max("event_date").alias("end"), F.count("*").alias("n_events"))
    grouped = grouped.withColumn("n_islands", F.count("*").over(Window.partitionBy("project", "folder")))
    assert said(clusters.clusters(events, 3).select(grouped.columns)) == said(grouped)


def test_neighbours_as_by_a_window_over_all_events(spark):
    events = frame(spark, random_events(600, 1) + random_events(30, 1))
    keys = events.where("subfolder <> '' AND event_date IS NOT NULL").select("project", "subfolder", "event_date", F.col("note_filename").alias("name")).distinct()
    order = Window.partitionBy("project", "subfolder").orderBy("event_date", "name")
    want = keys.withColumns({"prev": F.lag("name").over(order), "next": F.lead("name").over(order)})
    assert said(links.neighbours(events).select(want.columns)) == said(want)


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_sums_of_earlier_rows(spark, monkeypatch, width):
    monkeypatch.setattr(rows, "WIDTH", width)
    r = random.Random(2)
    df = spark.createDataFrame([(r.choice(["a", "b", None]), k * 3 - 200, r.randrange(3)) for k in range(300)] + [("c", None, 1)], "g string, ord long, v int").repartition(3)
    before = Window.partitionBy("g").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("before", F.coalesce(F.sum("v").over(before), F.lit(0)))
    assert said(rows.running_before(df, ["g"], "ord", F.col("v"), width)) == said(want)
    for limit in (1, 5, 1000):
        spent = df.withColumn("spent", F.coalesce(F.sum((F.col("v") > 1).cast("int")).over(before), F.lit(0))).where(F.col("spent") < limit)
        assert said(rows.within_budget(df, F.col("v") > 1, limit, "g")) == said(spent)


def test_entries_of_one_long_log(spark):
    r = random.Random(3)
    lines = [("f", k, f"## 2024-01-{k % 28 + 1:02} | scan" if r.random() < 0.2 else f"line {k}") for k in range(2000)] + [("g", 0, "no head"), ("g", 1, None), ("g", 2, "## t | u")]
    df = spark.createDataFrame(lines, "file string, pos long, line string").repartition(4)
    want, entry = {}, {}
    for file, _, line in lines:
        if line and line.startswith("## "):
            entry[file] = entry.get(file, 0) + 1
            want[file, entry[file]] = (line, [])
        elif file in entry and line is not None:
            want[file, entry[file]][1].append(line)
    got = {(x.file, x.entry): (x.header, x.body) for x in rows.log_entries(df).collect()}
    assert got == {k: (head, "\n".join(body)) for k, (head, body) in want.items()}


def test_one_project_of_a_million_events(spark):
    """No task sorts or holds the project: the largest one reads a small share of its rows."""
    events = spark.range(1_000_000).select(
        F.lit("p").alias("project"), F.date_add(F.lit(DAY), (F.col("id") % 3000).cast("int")).alias("event_date"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("note_filename"),
        F.lit("a").alias("subfolder"), F.col("id").alias("ord"), F.array().cast("array<string>").alias("parties"), F.lit("").alias("summary_hint"), F.lit("").alias("fallback_hint"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        near = links.neighbours(events).withColumn("task", F.spark_partition_id())
        counts = near.groupBy("task").count().agg(F.max("count"), F.sum("count")).first()
        assert counts[1] == 1_000_000 and counts[0] < 150_000
        assert clusters.clusters(events).first().n_events == 1_000_000
        spent = rows.running_before(events, ["project"], "ord", F.lit(1)).withColumn("task", F.spark_partition_id())
        assert spent.where("before <> ord").isEmpty() and spent.groupBy("task").count().agg(F.max("count")).first()[0] < 400_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def best_of_all(events, k=3):
    """The k best peers by all pairs."""
    best = Window.partitionBy("project", "name").orderBy(F.desc("score"), "peer_ord", "peer")
    return links.pair_scores(events).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("project", "name", "peer", "score", "rank")


@pytest.mark.parametrize("seed, crowd, k", [(0, 1, 3), (1, 4, 3), (2, 4, 1), (3, 20, 5), (4, 1, 2)])
def test_best_peers_in_a_crowd(spark, seed, crowd, k):
    events = frame(spark, random_events(250, seed, ("p", "q")))
    assert said(links.related(events, k, crowd)) == said(best_of_all(events, k))


def test_repeated_names_in_a_crowd(spark):
    own = [event("p", k % 20, f"2024-01-01 click {k % 9}", "a", ["x"], k) for k in range(60)] + [event("p", None, f"view {k}", "a", ["x"], 100 + k) for k in range(12)]
    events = frame(spark, own)
    assert said(links.related(events, 3, 2)) == said(best_of_all(events, 3))


def test_pairs_of_a_crowd_grow_with_its_events(spark):
    """One token in all notes: 2,000 events make 4,000,000 pairs, of which few are made."""
    made = {}
    for n in (500, 2000):
        events = spark.createDataFrame([event("p", k % 700, f"click n{k}x", "a", ["x"], k) for k in range(n)], model.EVENT)
        own = links.features(events).withColumn("keys", links.pair_keys())
        each = own.select("project", F.explode("keys").alias("key")).groupBy("project", "key").count().where("count > 64").select("project", "key")
        made[n] = links.crowded(own, each, 3).count()
    assert made[2000] < 40 * 2000 and made[2000] < 6 * made[500]
    assert said(links.related(events)) == said(best_of_all(events))


def test_images_between_dated_folders(spark):
    """As by looking at every file of a project, over several ranges, with nothing that reads on to a project's end for each file."""
    r = random.Random(5)
    files = sorted({(p, r.choice([f"2401{r.randrange(10, 30)} visit{r.randrange(9)}", f"S{r.randrange(9)}", "T/240105 u"]) + f"/{r.randrange(10_000)}." + r.choice(["jpg", "png", "pdf", "txt"])) for p in ["p"] * 8 + ["q", "r"] for _ in range(200)} | {("none", "S/1.jpg")})
    df = spark.createDataFrame(files, "project string, path string").repartition(3)
    want = {}
    for p, path in files:
        folder, ext = path.rsplit("/", 1)[0], path[-3:]
        dated = [f for q, f in files if q == p and "240" in f]
        near = [f.rsplit("/", 1)[0] for f in [x for x in dated if x < path][-1:] + [x for x in dated if x > path][:1]]
        want[p, path] = (folder, "folder") if "240" in folder else (path, "document") if ext == "pdf" else (near[0], "linked-image") if ext != "txt" and near else (None, "skip")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = detect.detect_events(df)
        assert {(x.project, x.path): (x.event, x.kind) for x in found.collect()} == want
        assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
        ranges = rows.filled(df, ["project"], "path", F.lit(1)).withColumn("task", F.spark_partition_id()).where("project = 'p'")
        assert ranges.groupBy("task").count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", [5])
def test_best_peers_of_small_projects_make_no_pairs_to_shuffle(spark, seed):
    """All of a small project are compared in one row: events are dealt once, and nothing is joined or put in order."""
    own = [e if e[0] else event(None, 1, f"n{k}", ord_=k) for k, e in enumerate(random_events(400, seed, ("p", "q", "r", "s", None)))]
    own += [event("twice", d, n, "a", ["x"], o) for d, n, o in [(1, "click 1", 1), (40, "click 1", 2), (40, "click 1", 2), (80, "click 2", 3), (80, "click 2", 5), (None, "click 3", 4)]]
    events = frame(spark, own)
    for crowd in (20, 200):
        found = links.best_peers(events, 3, crowd)
        got = links.related(events, 3, crowd)
        assert got.where("project <> 'twice'").count() > 900 and said(got) == said(links.related(events, 3, 0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


def test_pages_of_one_small_file_are_dealt_to_all_tasks(spark):
    old = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("project"), F.concat(F.lit("---\nproject: p"), "id", F.lit("\nproject: q"), "id", F.lit("\n---\n## Budget\n"), "id").alias("page"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = pages.existing(old).select("project", "frontmatter", "budget", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(x.project, x.frontmatter["project"], x.budget) for x in found} == {(str(k), f"q{k}", str(k)) for k in range(400)}
    assert len({x.task for x in found}) > 1
