"""Projects that hold the same files, and how they would be merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions.paths import basename, has_prefix, project_of_note, rewrite_prefix
from foliary.functions.scoring import jaccard
from foliary.session import written


def duplicates(index: DataFrame, domain: str, min_overlap: int = 3, min_confidence: float = 0.6) -> DataFrame:
    """[D6j, E4, E5] canonical, alias, overlap, confidence of project pairs by the Jaccard
    similarity of their fingerprints. The longer name is canonical, then the one with the
    later note, then the one that sorts first.

    Two projects that are similar enough share one of their rarest fingerprints, so only these
    pair projects: a fingerprint that very many have is left out of all but the smallest. Sizes and
    places rule most pairs out; those that are left are counted on the projects' sets."""
    rows = index.where(F.startswith("note_path", F.lit(domain + "/")) & (F.size(F.split("note_path", "/")) >= 3))
    rows = rows.select(project_of_note(F.col("note_path")).alias("project"), "fingerprint", F.regexp_extract(basename(F.col("note_path")), r"^\d{4}-\d{2}-\d{2}", 0).alias("day"))
    sets = written(project_sets(rows), "project-sets")
    needed = F.greatest(F.lit(max(1, min_overlap)), F.ceil(F.col("n") * F.lit(min_confidence) - 1e-9))
    prefix = F.greatest(F.size("prints") - needed + 1, F.lit(0)).cast("int")
    rare = sets.select("project", "n", F.size("prints").alias("own"), F.posexplode(F.slice("prints", F.lit(1), prefix)).alias("pos", "print"))
    a, b = rare.alias("a"), rare.alias("b")
    # What two projects must share, by their sizes; what they can, by the places of a print that they do share.
    least = F.greatest(F.lit(max(1, min_overlap)), F.ceil(F.lit(min_confidence) / F.lit(1 + min_confidence) * (F.col("a.n") + F.col("b.n")) - 1e-9))
    most = F.least("a.pos", "b.pos") + F.least(F.col("a.own") - F.col("a.pos"), F.col("b.own") - F.col("b.pos"))
    fits = (F.least("a.own", "b.own") >= F.greatest("a.n", "b.n") * F.lit(min_confidence) - 1e-9) & (most >= least)
    near = a.join(b, (F.col("a.print") == F.col("b.print")) & (F.col("a.project") < F.col("b.project")) & fits).select(F.col("a.project").alias("a"), F.col("b.project").alias("b")).distinct()
    both = near.select("a", "b", F.explode(F.array("a", "b")).alias("project")).join(sets, "project")
    side = lambda name: F.max(F.when(F.col("project") == F.col(name), F.struct("n", "latest", "prints")))
    pairs = both.groupBy("a", "b").agg(side("a").alias("x"), side("b").alias("y"))
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("x.prints", "y.prints")).cast("long")).where(F.col("overlap") >= min_overlap)
    confidence = jaccard(F.col("overlap"), F.col("x.n"), F.col("y.n"))
    second = (F.char_length("b") > F.char_length("a")) | ((F.char_length("b") == F.char_length("a")) & (F.col("y.latest") > F.col("x.latest")))
    out = pairs.select(F.when(second, F.col("b")).otherwise(F.col("a")).alias("canonical"), F.when(second, F.col("a")).otherwise(F.col("b")).alias("alias"), "overlap", confidence.alias("confidence"))
    return out.where((F.col("confidence") >= min_confidence) & (F.col("overlap") > 0))


def project_sets(rows: DataFrame) -> DataFrame:
    """[E4, E5] project, n (distinct fingerprints), latest (day), prints: the fingerprints that mean something,
    rarest first. One row a project, of 16 characters a fingerprint."""
    each = written(rows.groupBy("project", "fingerprint").agg(F.max("day").alias("day")), "project-prints")
    useful = ~F.col("fingerprint").isin("", "unknown")
    known = each.join(each.groupBy("fingerprint").agg(F.count("*").alias("times")), "fingerprint")
    listed = F.sort_array(F.collect_list(F.when(useful, F.struct("times", "fingerprint"))))
    return known.groupBy("project").agg(F.count("*").alias("n"), F.max("day").alias("latest"), F.transform(listed, lambda x: x["fingerprint"]).alias("prints"))


def merge_plan(index: DataFrame, domain: str, canonical: str, alias: str) -> DataFrame:
    """[R13, D19j] note_path, target, collides: where each of the alias's notes would go. Only
    whole path components are replaced, so 'X Final' isn't taken for 'X'."""
    old, new = f"{domain}/{alias}", f"{domain}/{canonical}"
    notes = index.where("note_path <> ''").select("note_path").distinct()
    plan = notes.where(has_prefix(F.col("note_path"), F.lit(old))).withColumn("target", rewrite_prefix(F.col("note_path"), old, new))
    taken = notes.select(F.col("note_path").alias("target"), F.lit(True).alias("collides"))
    return plan.join(taken, "target", "left").select("note_path", "target", F.coalesce("collides", F.lit(False)).alias("collides"))


def apply_prefix(index: DataFrame, column: str, old: str, new: str, boundary: bool = True) -> DataFrame:
    """[B4] The index with the prefix rewritten, and changed."""
    after = rewrite_prefix(F.col(column), old, new, boundary)
    return index.withColumn("changed", after != F.col(column)).withColumn(column, after)


def affected_notes(index: DataFrame, old_prefix: str) -> DataFrame:
    """[D13j] Notes whose sources are under a prefix; to be read before it is rewritten."""
    return index.where(has_prefix(F.col("source_path"), F.lit(old_prefix)) & (F.col("note_path") != "")).select("note_path").distinct()
