"""First seen, last seen, budgets, caps and counters over plain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.scoring import sha_prefix
from foliary.session import written


#: Numbers of an order that are looked at together.
WIDTH = 1 << 16


def first_seen(rows: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """[W5, U7] key, value and order of the first row of each key, and how many rows it has."""
    first = F.min_by(F.struct(value, order), order)
    return rows.groupBy(key).agg(first.alias("f"), F.count("*").alias("hits")).select(key, f"f.{value}", f"f.{order}", "hits")


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right where the keys are the same, nulls too."""
    other = right.select(*[F.col(k).alias(f"{k}_of_") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of_")) for k in keys]
    return left.join(other, same).drop(*[f"{k}_of_" for k in keys])


def running_before(rows: DataFrame, keys: list[str], order: str, value: Column, width: int = WIDTH, below: int | None = None) -> DataFrame:
    """rows with before: the sum of value over the rows of the key that come earlier in an integer order.

    A key's rows are cut into stretches of `width` numbers. Sums of the stretches are added up
    before any row is put in order, and then each stretch is a window of its own, so that a key
    that has very many rows is no one task's. With `below`, stretches that begin with as much go
    before anything is ordered."""
    stretch = F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62))).cast("long")
    cut = rows.withColumn("stretch_", stretch).withColumn("value_", value)
    sums = cut.groupBy(*keys, "stretch_").agg(F.sum("value_").alias("sum_"))
    earlier = Window.partitionBy(*keys).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    starts = sums.withColumn("start_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0))).drop("sum_")
    starts = starts.where(F.col("start_") < below) if below is not None else starts
    own = Window.partitionBy(*keys, "stretch_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = joined(cut, starts, [*keys, "stretch_"]).withColumn("before", F.col("start_") + F.coalesce(F.sum("value_").over(own), F.lit(0)))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], "before")


def filled(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """rows with before and after: the last value that isn't null among the rows of the key up to this one, and
    the first among those from this one on.

    Rows are dealt by ranges of keys and order, and each range of a key is a window of its own; what
    stands before and after it comes from windows over the ranges, a row each, so that a key that has
    very many rows is no one task's. No frame reaches forward, as Spark reads such a frame anew for each row."""
    cut = written(rows.withColumn("value_", value).repartitionByRange(*keys, order).withColumn("range_", F.spark_partition_id()), "ranges")
    at = F.when(F.col("value_").isNotNull(), F.col(order))
    ends = cut.groupBy(*keys, "range_").agg(F.min_by("value_", at).alias("first_"), F.max_by("value_", at).alias("last_"))
    over = lambda by, *w: Window.partitionBy(*keys, *w).orderBy(by).rowsBetween(Window.unboundedPreceding, 0 if w else -1)
    ends = ends.withColumn("earlier_", F.last("last_", ignorenulls=True).over(over(F.asc("range_")))).withColumn("later_", F.last("first_", ignorenulls=True).over(over(F.desc("range_"))))
    near = joined(cut, ends.drop("first_", "last_"), [*keys, "range_"])
    near = near.withColumn("before", F.coalesce(F.last("value_", ignorenulls=True).over(over(F.asc(order), "range_")), "earlier_"))
    near = near.withColumn("after", F.coalesce(F.last("value_", ignorenulls=True).over(over(F.desc(order), "range_")), "later_"))
    return near.select(*[F.col(f"`{c}`") for c in rows.columns], "before", "after")


def within_budget(rows: DataFrame, success: Column, limit: int, group: str) -> DataFrame:
    """[W6] Rows of a group until so many before them succeeded."""
    counted = running_before(rows, [group], "ord", F.coalesce(success.cast("int"), F.lit(0)), below=limit)
    return counted.withColumnRenamed("before", "spent").where(F.col("spent") < limit)


def newest(rows: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """[W7, S9, B6] The n newest rows; all if n is not positive."""
    return rows.orderBy(F.desc(order)).limit(n) if n > 0 else rows


def between(rows: DataFrame, day: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """[C11] Rows of the days from since to until, both included; rows without a day go once there is a bound."""
    rows = rows.where(F.col(day) >= F.to_date(F.lit(since))) if since else rows
    return rows.where(F.col(day) <= F.to_date(F.lit(until))) if until else rows


def folder_fingerprint(files: DataFrame) -> DataFrame:
    """[E12, S1] folder, fingerprint of the visible files directly in it (folder, name, size), by name."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("name", "size"))), lambda x: F.concat_ws("\t", x["name"], x["size"].cast("string")))
    return files.where("name NOT LIKE '.%'").groupBy("folder").agg(sha_prefix(F.array_join(listed, "\n")).alias("fingerprint"))


def counters(rows: DataFrame, kind: str) -> DataFrame:
    """[E6]"""
    return rows.groupBy(kind).agg(F.count("*").alias("n"))


def throughput(samples: DataFrame, least: int = 65_536, most: int = 5, fallback: float = 1_048_576.0) -> DataFrame:
    """[E9] One row per archive: n_samples, bytes_per_second (exact median), confidence."""
    order = Window.partitionBy("archive").orderBy("ord")
    used = samples.where(F.col("size") >= least).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    speeds = used.groupBy("archive").agg(F.count("*").alias("n_samples"), F.median(F.col("size") / F.col("seconds")).alias("speed"))
    all_ = samples.select("archive").distinct().join(speeds, "archive", "left")
    n = F.coalesce("n_samples", F.lit(0))
    return all_.select("archive", n.alias("n_samples"), F.coalesce("speed", F.lit(fallback)).alias("bytes_per_second"), F.when(n >= 3, "high").when(n > 0, "low").otherwise("none").alias("confidence"))


def slow_reads(files: DataFrame, bytes_per_second: float, limit: float = 30.0) -> DataFrame:
    """[C6] files with seconds, slow."""
    seconds = F.col("size") / F.lit(bytes_per_second)
    return files.withColumn("seconds", seconds).withColumn("slow", seconds > limit)


def repeated(index: DataFrame) -> DataFrame:
    """[E10] kind, key, n: source paths that stand twice, fingerprints with several paths."""
    paths = index.groupBy("source_path").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("path").alias("kind"), F.col("source_path").alias("key"), "n")
    prints = index.where("fingerprint NOT IN ('', 'unknown')").groupBy("fingerprint").agg(F.count_distinct("source_path").alias("n")).where("n > 1")
    return paths.unionByName(prints.select(F.lit("fingerprint").alias("kind"), F.col("fingerprint").alias("key"), "n"))


def images_to_embed(images: DataFrame, candidates: int = 20, embed: int = 10, least_bytes: int = 10_000) -> DataFrame:
    """[C7, R20, W12] The first 20 of a note, of these the first 10, of these the large enough ones
    and those of unknown size, one per content; row is the row of three they stand in."""
    order = Window.partitionBy("note").orderBy("ord")
    first = images.withColumn("k", F.row_number().over(order)).where(F.col("k") <= min(candidates, embed)).where((F.col("size") >= least_bytes) | (F.col("size") == 0))
    once = first.withColumn("copy", F.row_number().over(Window.partitionBy("note", "sha256").orderBy("ord"))).where("copy = 1")
    return once.withColumn("row", F.floor((F.row_number().over(order) - 1) / 3).cast("int")).drop("k", "copy")


def layered(layers: list[DataFrame], key: str) -> DataFrame:
    """[U1, A42, K10] Rows of all layers, one per key: the first layer that has it wins; its order is kept."""
    both = None
    for k, layer in enumerate(layers):
        layer = layer.withColumn("layer", F.lit(k))
        both = layer if both is None else both.unionByName(layer)
    best = Window.partitionBy(key).orderBy("layer", "ord")
    return both.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def log_entries(lines: DataFrame) -> DataFrame:
    """[A18, W11] lines (file, pos, line) -> file, entry, header, body: an entry is a header line
    `## timestamp | type` and the lines after it; lines before the first header belong to none."""
    head = F.coalesce(F.col("line").rlike(r"^## \S+ \| \S+"), F.lit(False))
    rows = running_before(lines.select("file", "pos", "line").withColumn("head", head), ["file"], "pos", F.col("head").cast("int"))
    rows = rows.withColumn("entry", F.col("before") + F.col("head").cast("int")).where("entry > 0")
    listed = F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    return rows.groupBy("file", "entry").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("header"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("body"))
