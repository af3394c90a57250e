"""Links between notes: related ones, neighbours in time, orphans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions import scoring, text
from foliary.functions.paths import wikilink
from foliary.operators.rows import joined
from foliary.session import written


def _meeting_keys(days: int) -> Callable[[Column, Column], Column]:
    """Keys of which two dates share one if they are at most `days` apart, and none if more than twice that."""
    week = F.floor(F.unix_date("event_date") / (days + 1))
    return lambda kind, value: F.transform(F.array(week, week + 1), lambda w: F.concat_ws("\x1f", kind, value, w.cast("string")))


def pair_keys() -> Column:
    """Keys of an event (tokens, parties, subfolder, event_date): two events of a project whose score is 4
    or more share one. What reaches 4: a token (5); the subfolder (3) with a party (2) or dates within 10
    days (1 or more); two parties (2 each); a party with dates within 7 days (2 or more); the same day (4)."""
    none = F.array().cast("array<string>")
    here = F.col("subfolder") != ""
    join = lambda kind, *x: F.concat_ws("\x1f", F.lit(kind), *x)
    sorted_ = F.array_sort(F.array_distinct("parties"))
    twos = F.flatten(F.transform(sorted_, lambda x, i: F.transform(F.slice(sorted_, i + 2, 1 << 30), lambda y: join("2", x, y))))
    dated = F.col("event_date").isNotNull()
    return F.array_distinct(
        F.concat(
            F.transform("tokens", lambda t: join("t", t)),
            F.when(here, F.transform(sorted_, lambda x: join("s", F.col("subfolder"), x))).otherwise(none),
            F.when(here & dated, _meeting_keys(10)(F.lit("w"), F.col("subfolder"))).otherwise(none),
            twos,
            F.when(dated, F.flatten(F.transform(sorted_, lambda x: _meeting_keys(7)(F.lit("p"), x)))).otherwise(none),
            F.when(dated, F.array(join("d", F.col("event_date").cast("string")))).otherwise(none),
        )
    )


def features(events: DataFrame) -> DataFrame:
    """What scores are made of, for events with a name; names may repeat in a project."""
    return events.where("note_filename <> ''").select(
        "project", "note_filename", "subfolder", "event_date", "ord",
        F.array_distinct(F.concat(text.tokens(F.col("note_filename")), text.tokens(F.col("summary_hint")))).alias("tokens"),
        F.coalesce("parties", F.array().cast("array<string>")).alias("parties"),
    )


def _score(a: Callable[[str], Column], b: Callable[[str], Column], shared: Callable[[str], Column]) -> Column:
    """The score of two features, whose columns a and b give by name, and shared how many of a list both have."""
    return scoring.pair_score(shared("tokens"), (a("subfolder") != "") & (a("subfolder") == b("subfolder")), shared("parties"), a("event_date"), b("event_date"))


def scored(pairs: DataFrame) -> DataFrame:
    """project, name, subfolder, peer, peer_ord, score of pairs of features a and b."""
    score = _score(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), lambda c: F.size(F.array_intersect(f"a.{c}", f"b.{c}")))
    return pairs.select(F.col("a.project").alias("project"), F.col("a.note_filename").alias("name"), F.col("a.subfolder").alias("subfolder"), F.col("b.note_filename").alias("peer"), F.col("b.ord").alias("peer_ord"), score.alias("score"), F.col("a.ord").alias("ord"))


def meeting(rows: DataFrame) -> DataFrame:
    """Pairs of rows (features, keys, key) of a project that share a key, under the first one that both have."""
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.project") == F.col("b.project")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.note_filename") != F.col("b.note_filename")))
    return pairs.where(F.col("a.key") == F.array_min(F.array_intersect("a.keys", "b.keys")))


def pair_scores(events: DataFrame, least: float = scoring.LEAST_RELATED) -> DataFrame:
    """[D11j, F60] project, name, peer, peer_ord, score of ordered pairs in a project that reach `least`
    (4 or more). Events meet under keys that such pairs share, so that those of a large project aren't
    all compared; a pair counts under the first of its keys only. These are all such pairs; `related`
    has the best ones of each event, without making the others."""
    if least < scoring.LEAST_RELATED:
        raise ValueError("events that score less than 4 need not share a key")
    rows = features(events).withColumn("keys", pair_keys()).withColumn("key", F.explode("keys"))
    return scored(meeting(rows)).drop("ord").where(F.col("score") >= least)


def combinations(values: Column, most: int = 3) -> Column:
    """The subsets of up to `most` values, each joined to one string; the values are sorted first."""
    own = F.array_sort(F.array_distinct(values))
    ones = F.transform(own, lambda v: F.concat(F.lit("\x1e"), v))
    twos = F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.lit(1 << 30)), lambda y: F.concat(F.lit("\x1e"), x, F.lit("\x1e"), y))))
    threes = F.flatten(F.transform(own, lambda x, i: F.flatten(F.transform(F.slice(own, i + 2, F.lit(1 << 30)), lambda y, j: F.transform(F.slice(own, i + j + 3, F.lit(1 << 30)), lambda z: F.concat(F.lit("\x1e"), x, F.lit("\x1e"), y, F.lit("\x1e"), z))))))
    return F.concat(F.array(F.lit("")), ones, twos, threes)


def crowded(rows: DataFrame, hot: DataFrame, k: int) -> DataFrame:
    """Of events that share hot keys (project, key): pairs (a, b) that hold the k best peers of each which share
    none but such keys with it.

    Events are grouped by what two of them can share: up to three hot tokens, the subfolder, up to
    three parties. All that share such a group with an event score at least as the group says, and the
    dates decide between them; so of a group only the k nearest in time, and the k first by order, can be
    among an event's best. These are the same for all events of a day: each day's first ones are kept, a
    window over the days of a group gathers the nearest, and events meet these few."""
    named = rows.select("project", "note_filename", "ord").groupBy("project", "note_filename").agg(F.count("*").alias("n")).groupBy("project").agg(F.max("n").alias("times"))
    room = F.lit(k) + F.col("times")  # an event's own rows are no peers of it
    hot_tokens = hot.where(F.startswith("key", F.lit("t\x1f"))).select("project", F.substring("key", 3, 1 << 30).alias("token")).groupBy("project").agg(F.collect_set("token").alias("hot_tokens"))
    in_crowd = rows.withColumn("key", F.explode("keys")).join(hot, ["project", "key"], "left_semi").select("project", "note_filename", "ord").distinct()
    own = rows.join(in_crowd, ["project", "note_filename", "ord"], "left_semi").join(hot_tokens, "project", "left").join(named, "project")
    shared = F.filter("tokens", lambda t: F.coalesce(F.array_contains("hot_tokens", t), F.lit(False)))
    folder = F.when(F.col("subfolder") != "", F.array(F.lit(""), F.col("subfolder"))).otherwise(F.array(F.lit("")))
    group = lambda t: F.flatten(F.transform(folder, lambda s: F.transform(combinations(F.col("parties")), lambda p: F.concat_ws("\x1f", t, s, p))))
    own = own.withColumn("group", F.explode(F.flatten(F.transform(combinations(shared), group))))
    first = Window.partitionBy("project", "group", "event_date").orderBy("ord", "note_filename")
    most = k + (named.agg(F.max("times")).first()[0] or 1)  # a constant lets tasks drop the rest before the shuffle
    heads = own.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most).where(F.col("nth") <= room)
    peer = F.struct("ord", "note_filename", "subfolder", "event_date", "tokens", "parties")
    by_day = heads.groupBy("project", "group", "event_date").agg(F.array_sort(F.collect_list(peer)).alias("heads"), F.max("times").alias("times"))
    around = Window.partitionBy("project", "group").orderBy(F.coalesce(F.unix_date("event_date"), F.lit(-(1 << 30)))).rangeBetween(-13, 13)  # days of a group
    far = F.lit(1 << 20)
    nearest = F.array_sort(F.transform(F.flatten(F.collect_list("heads").over(around)), lambda p: F.struct(F.coalesce(F.abs(F.datediff(p["event_date"], F.col("event_date"))), far).alias("days"), p["ord"].alias("ord"), p.alias("peer"))))
    near = by_day.withColumn("near", nearest).select("project", "group", "event_date", F.slice("near", F.lit(1), room.cast("int")).alias("near"))
    all_days = by_day.groupBy("project", "group").agg(F.slice(F.array_sort(F.flatten(F.collect_list("heads"))), F.lit(1), (F.lit(k) + F.max("times")).cast("int")).alias("first"))
    chosen = near.join(all_days, ["project", "group"]).select(F.col("project").alias("p"), F.col("group").alias("g"), F.col("event_date").alias("d"), F.array_distinct(F.concat(F.transform("near", lambda x: x["peer"]), "first")).alias("peers"))
    met = own.join(chosen, (F.col("project") == F.col("p")) & (F.col("group") == F.col("g")) & F.col("event_date").eqNullSafe(F.col("d")))
    a = F.struct("project", "note_filename", "subfolder", "event_date", "ord", "tokens", "parties").alias("a")
    return met.select(a, F.explode("peers").alias("b")).where("a.note_filename <> b.note_filename").distinct()


def among_all(rows: DataFrame, k: int) -> DataFrame:
    """project, name, peers (score, peer): the k best of features whose projects are small, best first. An
    event is compared with all of its project, which is one row; so no pair is ever shuffled or sorted. Pairs
    are only scored if they may reach 4 (see pair_keys): two lists may share an item if their marks, a bit for
    each item's hash, have one in common."""
    marks = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    event = F.struct("note_filename", "subfolder", "event_date", "ord", "tokens", "parties", marks("tokens").alias("m_tokens"), marks("parties").alias("m_parties"), F.unix_date("event_date").alias("day"))
    whole = rows.where("project IS NOT NULL AND tokens IS NOT NULL").repartition("project").groupBy("project").agg(F.collect_list(event).alias("all"))
    meets = lambda a, b, c: a[f"m_{c}"].bitwiseAND(b[f"m_{c}"]) != 0
    shared = lambda a, b, c: F.when(meets(a, b, c), F.size(F.array_intersect(a[c], b[c]))).otherwise(0)
    here = lambda a, b: a["subfolder"] == b["subfolder"]
    soon = lambda a, b: F.abs(a["day"] - b["day"]) <= 10
    party = lambda a, b: meets(a, b, "parties") & (here(a, b) | soon(a, b) | (F.size(a["parties"]) > 1))
    may = lambda a, b: meets(a, b, "tokens") | party(a, b) | (here(a, b) & soon(a, b)) | (a["day"] == b["day"])
    score = lambda a, b: _score(lambda c: a[c], lambda c: b[c], lambda c: shared(a, b, c))
    pair = lambda a, b: F.struct((-score(a, b)).alias("minus"), b["ord"].alias("peer_ord"), b["note_filename"].alias("peer"), a["ord"].alias("ord"), a["subfolder"].alias("subfolder"))
    of_event = lambda a: F.filter(F.transform(F.filter("all", lambda b: may(a, b) & (b["note_filename"] != a["note_filename"])), lambda b: pair(a, b)), lambda p: p["minus"] <= -scoring.LEAST_RELATED)
    of_name = lambda n: F.struct(n.alias("name"), F.sort_array(F.flatten(F.transform(F.filter("all", lambda a: a["note_filename"] == n), of_event))).alias("pairs"))
    each = whole.select("project", F.explode(F.transform(F.array_distinct(F.transform("all", lambda e: e["note_filename"])), of_name)).alias("of")).select("project", "of.name", "of.pairs")
    once = F.filter("pairs", lambda p, i: (i == 0) | (p != F.get("pairs", i - 1)))
    return each.select("project", "name", F.transform(F.slice(once, 1, k), lambda p: F.struct((-p["minus"]).alias("score"), p["peer"].alias("peer"))).alias("peers"))


def among_keys(rows: DataFrame, k: int, crowd: int) -> DataFrame:
    """The same for projects of any size: events meet under the keys that they share. Under a key that more
    than `crowd` events of a project share, not all pairs are made, but those that can be among the k best."""
    rows = rows.withColumn("keys", pair_keys())
    each = rows.select("project", F.explode("keys").alias("key"))
    hot = each.groupBy("project", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("project", "key")
    hot_keys = hot.groupBy("project").agg(F.collect_list("key").alias("hot"))
    cold = rows.join(hot_keys, "project", "left").withColumn("keys", F.array_except("keys", F.coalesce("hot", F.array().cast("array<string>")))).drop("hot")
    pairs = scored(meeting(cold.withColumn("key", F.explode("keys")))).unionByName(scored(crowded(rows, hot, k)))
    pairs = pairs.where(F.col("score") >= scoring.LEAST_RELATED).distinct()
    best = Window.partitionBy("project", "name").orderBy(F.desc("score"), "peer_ord", "peer")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    listed = F.sort_array(F.collect_list(F.struct("rank", "score", "peer")))
    return ranked.groupBy("project", "name").agg(F.transform(listed, lambda p: F.struct(p["score"].alias("score"), p["peer"].alias("peer"))).alias("peers"))


def best_peers(events: DataFrame, k: int = 3, crowd: int = 64) -> DataFrame:
    """project, name, peers (score, peer): the k best of each event, best first; ties by the peer's order, then
    by its name. In projects of up to twice `crowd` events all are compared, and in larger ones those that share
    a key; so the pairs grow with the events, also if all of a project share a token."""
    rows = features(events)
    large = written(rows.groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") > 2 * crowd).select("project"), "large-projects")
    if large.isEmpty():
        return among_all(rows, k)
    return among_all(rows.join(large, "project", "left_anti"), k).unionByName(among_keys(rows.join(large, "project", "left_semi"), k, crowd))


def related(events: DataFrame, k: int = 3, crowd: int = 64) -> DataFrame:
    """[W3] The k best peers of each event, a row each."""
    rows = best_peers(events, k, crowd).select("project", "name", F.posexplode("peers").alias("pos", "p"))
    return rows.select("project", "name", "p.peer", "p.score", (F.col("pos") + 1).alias("rank"))


def neighbours(events: DataFrame) -> DataFrame:
    """[W2] project, subfolder, name, prev, next in order of date and name. Rows that repeat a
    date and name count once.

    Each day of a folder is a window of its own; what stands before its first name and after its
    last one comes from a window over the days."""
    day = ["project", "subfolder", "event_date"]
    rows = events.where("subfolder <> '' AND event_date IS NOT NULL").select(*day, F.col("note_filename").alias("name"))
    keys = rows.repartition(*day).distinct()  # dealt once for the rows of a day, which are all that follows needs together
    over = Window.partitionBy("project", "subfolder").orderBy("event_date")
    ends = rows.groupBy(*day).agg(F.min("name").alias("first"), F.max("name").alias("last"))  # before the shuffle, a row a day of each task
    ends = ends.select(*day, F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after"))
    own = Window.partitionBy(*day).orderBy("name")
    near = joined(keys.select(*day, "name", F.lag("name").over(own).alias("p"), F.lead("name").over(own).alias("n")), ends, day)
    return near.select(*day, "name", F.coalesce("p", "before").alias("prev"), F.coalesce("n", "after").alias("next"))


def wikilinks(notes: DataFrame) -> DataFrame:
    """src, target of every [[target]] in the bodies."""
    found = F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\[\]]+)\]\]"), 1))
    return notes.select(F.col("stem").alias("src"), found.alias("target"))


def orphans(notes: DataFrame) -> DataFrame:
    """[D10j] Notes (stem, body) that no other note links to."""
    edges = wikilinks(notes).where("src <> target").select(F.col("target").alias("stem")).distinct()
    return notes.join(edges, "stem", "left_anti")


def _least_paths(notes: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first notes by path of each key: k + 1, as one may be the orphan itself."""
    first = Window.partitionBy(*keys).orderBy("vault_path")
    return notes.withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= k + 1).drop("nth")


def candidates(orphan: DataFrame, notes: DataFrame, k: int = 20) -> DataFrame:
    """[D12j, F61, S3] orphan, candidate, score: notes of the orphan's project, best first, one per path.

    A score is made of how near the dates are and whether the first folders agree, and ties go by
    path; so of the notes of one day, of one day and folder, of one folder, and of a whole project
    only the first few by path can be among an orphan's best, and no other is compared."""
    folder = lambda path: F.array_join(F.slice(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != ""), 1, 2), "/")
    once = notes.select("project", "event_date", "file_type", "source_path", "vault_path").distinct().withColumn("folder", folder(F.col("source_path")))
    mine = orphan.select("project", "event_date", "file_type", "source_path", "vault_path").withColumn("folder", folder(F.col("source_path")))
    once, mine = written(once, "candidates"), written(mine, "orphans")
    far = mine.withColumn("day", F.explode(F.sequence(F.date_sub("event_date", 3), F.date_add("event_date", 3)))).where("event_date IS NOT NULL")
    ways = [
        (mine, _least_paths(once, k, "project"), ["project"]),
        (mine, _least_paths(once, k, "project", "folder"), ["project", "folder"]),
        (far, _least_paths(once, k, "project", "event_date").withColumnRenamed("event_date", "day"), ["project", "day"]),
        (far, _least_paths(once, k, "project", "event_date", "folder").withColumnRenamed("event_date", "day"), ["project", "day", "folder"]),
    ]
    met = None
    for left, right, keys in ways:
        right = right.withColumn("date_b", F.col("day" if "day" in keys else "event_date")).select(*keys, "date_b", F.col("source_path").alias("path_b"), F.col("vault_path").alias("candidate"))
        pairs = left.join(right, keys).where("vault_path <> candidate").select("project", "event_date", "file_type", "source_path", F.col("vault_path").alias("orphan"), "date_b", "path_b", "candidate")
        met = pairs if met is None else met.unionByName(pairs)
    score = scoring.relevance(F.col("project"), F.col("project"), F.col("event_date"), F.col("date_b"), F.col("file_type"), F.col("source_path"), F.col("path_b"))
    best = Window.partitionBy("orphan").orderBy(F.desc("score"), "candidate")
    return met.select("orphan", "candidate", score.alias("score")).groupBy("orphan", "candidate").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_notes(notes: DataFrame, words: str, limit: int = 500) -> DataFrame:
    """[A15] Notes whose path or body holds the words, without regard to case, the first by path."""
    said = F.lit(words.lower())
    return notes.where(F.contains(F.lower("body"), said) | F.contains(F.lower("vault_path"), said)).orderBy("vault_path").limit(limit)


def sections(events: DataFrame, k: int = 3) -> DataFrame:
    """[R7, F20] name, section: the marked block of related notes and neighbours; none without either."""
    links = best_peers(events, k).where("size(peers) > 0")
    lines = F.array_join(F.transform("peers", lambda p: F.concat(F.lit("- "), wikilink(p["peer"]))), "\n")
    links = links.select("project", "name", F.concat(F.lit("## Related\n\n"), lines).alias("related"))
    near = neighbours(events).select(
        "project", "name",
        F.concat(F.lit("← Previous in "), "subfolder", F.lit(": "), wikilink(F.col("prev")), F.lit("  ")).alias("p"),
        F.concat(F.lit("→ Next in "), "subfolder", F.lit(": "), wikilink(F.col("next"))).alias("n"),
    ).withColumn("near", F.nullif(F.concat_ws("\n", "p", "n"), F.lit("")))
    names = events.select("project", F.col("note_filename").alias("name")).distinct()
    both = names.join(links, ["project", "name"], "left").join(near.select("project", "name", "near"), ["project", "name"], "left")
    inner = F.concat_ws("\n\n", "related", "near")
    return both.where("related IS NOT NULL OR near IS NOT NULL").select("project", "name", F.concat(F.lit(text.MARKER_START + "\n"), inner, F.lit("\n" + text.MARKER_END)).alias("section"))
