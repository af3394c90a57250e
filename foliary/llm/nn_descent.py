"""Near duplicates among vectors by NN-descent, with exact counts inside what it connects.

Equal vectors are one class. Classes get neighbour lists: first from windows of rows that random
rotations sort near each other, then by descent: the neighbours of a vector, and those that have
it as a neighbour, are compared with each other, and each keeps its best. A list that is full of
links is saturated, and grows to twice its length. Lists hold neighbours of a cosine of `REACH`
or more: those further away are as near as chance makes them and lead nowhere.

Links found connect components. A component's vectors are then all compared, so that no list's
length bounds what is counted: they are laid out along the rotations in buckets, each bucket
counts its own links, and two buckets are told by their centres and radii to be linked
completely, not at all, or to need comparing. A group of n near copies is a few buckets that
link completely: it takes neither n squared rows nor products.

Recall is audited after every round: a sample of `AUDIT` vectors, chosen by a hash, is compared
with all vectors, and what is in their components is counted against what should be. Below
`ENOUGH`, a further round follows, with windows along another rotation.

Edge cases: null and empty vectors, zero vectors and those with null or non-finite components
link with nothing; vectors of different lengths don't link. Each row is a vector, also if it
repeats a vec_id; equal rows link. A row whose vec_id is null counts as a link of others, but
names no component unless no other row does: then component_id is null. Where component_id or
vec_id is null, kept is true for vectors alone in their component and false for others. Of rows
that repeat the smallest vec_id, all are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import vectors
from foliary.llm.jaccard_rtree import bounded, components
from foliary.llm.scratch import Scratch

#: Length of a list at first, and at most: beyond it the components' exact counts take over.
LIST, LONGEST = 8, 64
REACH = 0.5
#: Rotations in the first round, and hashes of a rotation's code.
TABLES, HASHES = 6, 3
#: Rows of a window; each is compared with itself and the next one.
WINDOW = 64
#: A vector's neighbours are compared with each other so many at a time.
TOGETHER = 48
AUDIT, ENOUGH, ROUNDS = 512, 0.995, 8
#: Vectors of a bucket.
BUCKET = 1024
#: Summaries of buckets that are broadcast at once.
SUMMARIES = 16_384
MARGIN = 1e-7
EDGES = "u long, v long, s double"


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


@lru_cache(maxsize=64)
def rotation(table: int, k: int, dim: int) -> np.ndarray:
    return np.random.default_rng([table, k, dim]).standard_normal((dim, dim))


def code(x: np.ndarray, table: int) -> np.ndarray:
    """Cross-polytope hashes of one rotation after another: the axis that is nearest, and its sign."""
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(HASHES):
        r = x @ rotation(table, k, x.shape[1])
        at = np.abs(r).argmax(axis=1)
        out = out * (2 * x.shape[1]) + 2 * at + (r[np.arange(len(x)), at] > 0)
    return out


def one_length(batch: pa.RecordBatch) -> np.ndarray:
    return units(vectors.matrices(batch.column("embedding"))[0][1]) if batch.num_rows else np.zeros((0, 1))


def edges(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    u, v, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], names=["u", "v", "s"])


def top(ids: np.ndarray, others: np.ndarray, s: np.ndarray, k: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row of s at most k of those that are above its floor and not itself: u, v, s."""
    s = np.where(ids[:, None] == others[None], -2.0, s)
    width = min(int(k.max()), s.shape[1]) if len(k) else 0
    at = np.argpartition(-s, width - 1, axis=1)[:, :width] if 0 < width < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    best = np.take_along_axis(s, at, axis=1)
    if (k < width).any():
        order = np.argsort(-best, axis=1, kind="stable")
        at, best = np.take_along_axis(at, order, axis=1), np.take_along_axis(best, order, axis=1)
        best = np.where(np.arange(best.shape[1])[None] < k[:, None], best, -2.0)
    r, c = np.nonzero(best > floor[:, None])
    return ids[r], others[at[r, c]], best[r, c]


def windows(vecs: DataFrame, table: int) -> DataFrame:
    """Edges of vectors that a rotation sorts near each other."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = one_length(batch)
            own = code(x, table) if len(x) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(own, pa.int64()), batch.column("embedding")], names=["class", "code", "embedding"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []
        for batch in batches:
            ids, x = batch.column("class").to_numpy(), one_length(batch)
            for k in range(0, len(ids), WINDOW):
                own, m = ids[k : k + WINDOW], x[k : k + WINDOW]
                both, mm = (np.concatenate([last[0], own]), np.concatenate([last[1], m])) if last else (own, m)
                s, n = mm @ mm.T, len(both)
                yield edges([top(both, both, s, np.full(n, LIST), np.full(n, REACH))])
                last = [own, m]

    kind = vecs.schema["embedding"].dataType.simpleString()
    keyed = vecs.select("class", "embedding").mapInArrow(hashed, f"class long, code long, embedding {kind}")
    return keyed.repartitionByRange("code", "class").sortWithinPartitions("code", "class").mapInArrow(look, EDGES)


def descent(vecs: DataFrame, lists: DataFrame, room: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges between the neighbours of each vector, in either direction.

    A vector with more than TOGETHER of them has them dealt by a hash; none is dropped."""
    both = lists.select(F.col("u").alias("w"), F.col("v").alias("class")).union(lists.select(F.col("v").alias("w"), F.col("u").alias("class"))).distinct()
    both = scratch.save(both, "both")
    many = scratch.save(both.groupBy("w").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("parts")).where("parts > 1"), "many")
    dealt = both.join(bounded(many), "w", "left").select("w", F.pmod(F.xxhash64("w", "class"), F.coalesce("parts", F.lit(1))).alias("part"), "class")
    each = both.groupBy("w").agg(F.lit(None).cast("long").alias("part")).join(bounded(many), "w", "left")
    each = each.select("w", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("w").alias("class"))
    rows = dealt.union(each).join(room, "class").join(vecs.select("class", "embedding"), "class")
    rows = rows.repartition("w", "part").sortWithinPartitions("w", "part")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            batch = table.combine_chunks().to_batches()[0]
            w, part, ids = (batch.column(n).to_numpy() for n in ("w", "part", "class"))
            k, floor, x = batch.column("k").to_numpy(), batch.column("floor").to_numpy(), one_length(batch)
            at = np.concatenate([[0], np.flatnonzero((w[1:] != w[:-1]) | (part[1:] != part[:-1])) + 1, [len(w)]])
            return edges([top(ids[a:b], ids[a:b], x[a:b] @ x[a:b].T, k[a:b], floor[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])

        for batch in batches:
            if not batch.num_rows:
                continue
            w, part = batch.column("w").to_numpy(), batch.column("part").to_numpy()
            cut = np.flatnonzero((w != w[-1]) | (part != part[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut or (held and (held[-1].column("w")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (w[0], part[0])):
                if held or cut:
                    yield done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield done(pa.Table.from_batches(held))

    return rows.select("w", "part", "class", "k", "floor", "embedding").mapInArrow(look, EDGES)


def best_of(found: DataFrame, room: DataFrame) -> DataFrame:
    """Each vector's k best of all edges found."""
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    once = found.groupBy("u", "v").agg(F.max("s").alias("s"))
    first = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LONGEST)
    return first.join(room.select(F.col("class").alias("u"), "k"), "u").where("rank <= k").select("u", "v", "s")


def roomier(lists: DataFrame, room: DataFrame, link: float) -> DataFrame:
    """class, k, floor: lists that hold nothing but links get twice the room; a full one's worst is its floor."""
    now = lists.groupBy(F.col("u").alias("class")).agg(F.count("*").alias("n"), F.min("s").alias("worst"))
    both = room.select("class", "k").join(now, "class", "left")
    full = F.coalesce(F.col("n") >= F.col("k"), F.lit(False))
    k = F.when(full & (F.col("worst") >= link), F.least(F.col("k") * 2, F.lit(LONGEST))).otherwise(F.col("k"))
    return both.select("class", k.cast("int").alias("k"), F.when(full & (k == F.col("k")), F.col("worst")).otherwise(F.lit(REACH)).alias("floor"))


def audited(vecs: DataFrame, comp: DataFrame, sample: DataFrame, link: float) -> float:
    """The share of the sample's links whose other end is in its component: the smaller of the mean over
    vectors and that over links."""
    spark = vecs.sparkSession
    own = sample.join(comp, F.col("class") == F.col("node"), "left").select("class", F.coalesce("comp", "class").alias("comp"), "embedding").toArrow().combine_chunks()
    if not own.num_rows:
        return 1.0
    batch = own.to_batches()[0]
    sent = spark.sparkContext.broadcast((batch.column("class").to_numpy(), batch.column("comp").to_numpy(), one_length(batch)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, comps, x = sent.value
        there, found = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            linked = (x @ one_length(batch).T >= link) & (ids[:, None] != batch.column("class").to_numpy()[None])
            same = comps[:, None] == batch.column("comp").to_numpy()[None]
            there += linked.sum(axis=1)
            found += (linked & same).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(there), pa.array(found)], names=["class", "there", "found"])

    rows = vecs.join(bounded(comp), F.col("class") == F.col("node"), "left").select("class", F.coalesce("comp", "class").alias("comp"), "embedding")
    counts = rows.mapInArrow(look, "class long, there long, found long").groupBy("class").agg(F.sum("there").alias("there"), F.sum("found").alias("found")).where("there > 0")
    all_of = counts.agg(F.avg(F.col("found") / F.col("there")), F.sum("found") / F.sum("there")).first()
    return 1.0 if all_of[0] is None else min(all_of)


def connected(vecs: DataFrame, link: float, scratch: Scratch) -> DataFrame:
    """node, comp of all classes for which a link was found."""
    room = scratch.save(vecs.select("class", F.lit(LIST).alias("k"), F.lit(REACH).cast("double").alias("floor")), "room-0")
    sample = scratch.save(vecs.orderBy(F.xxhash64("class", F.lit("audit"))).limit(AUDIT).select("class", "embedding"), "sample")
    for t in range(TABLES):
        scratch.save(windows(vecs, t), f"windows-{t}")
    read = lambda *names: vecs.sparkSession.read.schema(EDGES).parquet(*[f"{scratch.root}/{n}" for n in names])
    lists = scratch.save(best_of(read(*[f"windows-{t}" for t in range(TABLES)]), room), "lists-0")
    scratch.drop(*[f"windows-{t}" for t in range(TABLES)])
    comp = None
    for r in range(1, ROUNDS + 1):
        room = scratch.save(roomier(lists, room, link), f"room-{r}")
        scratch.save(descent(vecs, lists, room, scratch), "descent")
        found = ["descent", f"lists-{r - 1}"]
        if r > 1:
            scratch.save(windows(vecs, TABLES + r), "more")
            found.append("more")
        lists = scratch.save(best_of(read(*found), room), f"lists-{r}")
        scratch.drop("both", "many", "more", "descent", f"lists-{r - 1}", f"room-{r - 1}")
        links = lists.where(F.col("s") >= link).select(F.col("u").alias("a"), F.col("v").alias("b"))
        comp = scratch.save(components(links, scratch, f"c{r}"), f"comp-{r}")
        recall = audited(vecs, comp, sample, link)
        if recall >= ENOUGH:
            break
    return comp


# --- exact counts inside components -----------------------------------------------


def laid_out(members: DataFrame, link: float) -> DataFrame:
    """members: comp, class, times, embedding -> class, comp, bucket, times, own (links inside the bucket), embedding."""
    kind = members.schema["embedding"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = code(one_length(batch), 0) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "code"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = TaskContext.get().partitionId() << 36, []

        def done(rows: pa.Table) -> pa.RecordBatch:
            nonlocal bucket
            batch = rows.combine_chunks().to_batches()[0]
            comp, times, x = batch.column("comp").to_numpy(), batch.column("times").to_numpy(), one_length(batch)
            cuts = np.concatenate([[0], np.flatnonzero(comp[1:] != comp[:-1]) + 1, [len(comp)]])
            own, names = np.zeros(len(comp), dtype=np.int64), np.zeros(len(comp), dtype=np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for k in range(a, b, BUCKET):
                    part = slice(k, min(k + BUCKET, b))
                    own[part] = (x[part] @ x[part].T >= link) @ times[part] - times[part]
                    names[part] = bucket
                    bucket += 1
            return pa.RecordBatch.from_arrays([batch.column("class"), batch.column("comp"), pa.array(names), batch.column("times"), pa.array(own), batch.column("embedding")], names=["class", "comp", "bucket", "times", "own", "embedding"])

        for batch in batches:
            if batch.num_rows:
                comp = batch.column("comp").to_numpy()
                same = np.flatnonzero(comp != comp[-1])
                cut = int(same[-1]) + 1 if len(same) else 0
                if cut:
                    yield done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held = [batch.slice(cut)]
                else:
                    held.append(batch)
                if sum(h.num_rows for h in held) >= 8 * BUCKET:  # a long component goes on in further buckets
                    yield done(pa.Table.from_batches(held))
                    held = []
        if held:
            yield done(pa.Table.from_batches(held))

    rows = members.select("comp", "class", "times", "embedding").mapInArrow(hashed, f"comp long, class long, times long, embedding {kind}, code long")
    rows = rows.repartitionByRange("comp", "code", "class").sortWithinPartitions("comp", "code", "class")
    return rows.mapInArrow(place, f"class long, comp long, bucket long, times long, own long, embedding {kind}")


def summaries(placed: DataFrame) -> DataFrame:
    """bucket, comp, weight, centre, radius (the largest angle to the centre)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in by_bucket(batches):
            batch = table.combine_chunks().to_batches()[0]
            x = one_length(batch)
            mean = x.mean(axis=0)
            size = np.linalg.norm(mean)
            centre = mean / size if size > 1e-6 else x[0]
            radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
            columns = [pa.array([key], pa.int64()), batch.column("comp").slice(0, 1), pa.array([batch.column("times").to_numpy().sum()], pa.int64()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "comp", "weight", "centre", "radius"])

    rows = placed.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(look, "bucket long, comp long, weight long, centre array<double>, radius double")


def by_bucket(batches: Iterator[pa.RecordBatch], name: str = "bucket") -> Iterator[tuple[int, pa.Table]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(name).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[0].column(name)[0].as_py() != key[a]:
                yield held[0].column(name)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(name)[0].as_py(), pa.Table.from_batches(held)


def against(table: DataFrame, summary: DataFrame, link: float, scratch: Scratch) -> DataFrame:
    """bucket, other, add: for pairs of buckets of a component, add is the other's weight (other is null) if
    they are linked completely, and 0 if their vectors are to be compared. In blocks of summaries."""
    spark, most = table.sparkSession, float(np.arccos(link))
    blocks = max(1, -(-summary.count() // SUMMARIES))
    out = []
    for b in range(blocks):
        own = summary.where(F.pmod(F.xxhash64("bucket"), F.lit(blocks)) == b).toArrow()
        bucket, comp, weight, radius = (own[n].to_numpy() for n in ("bucket", "comp", "weight", "radius"))
        centre = [own["centre"].combine_chunks().flatten().to_numpy(), len(bucket)]
        sent = spark.sparkContext.broadcast((bucket, comp, weight, radius, centre))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bucket, comp, weight, radius, (flat, n) = sent.value
            centre = flat.reshape(n, -1)
            for batch in batches:
                for r in batch.to_pylist():
                    rows = np.flatnonzero((comp == r["comp"]) & (bucket != r["bucket"]))
                    angle = np.arccos(np.clip(centre[rows] @ np.array(r["centre"]), -1, 1))
                    spread = radius[rows] + r["radius"]
                    whole, none = angle + spread <= most - MARGIN, angle - spread > most + MARGIN
                    mixed = rows[~whole & ~none]
                    found = [(r["bucket"], None, int(weight[rows[whole]].sum()))] + [(r["bucket"], int(bucket[x]), 0) for x in mixed]
                    yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "other", "add"), x, strict=True)) for x in found], schema=pa.schema([("bucket", pa.int64()), ("other", pa.int64()), ("add", pa.int64())]))

        out.append(scratch.save(summary.mapInArrow(look, "bucket long, other long, add long"), f"against-{b}"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def compared(placed: DataFrame, pairs: DataFrame, link: float) -> DataFrame:
    """class, add: links between the vectors of the pairs of buckets (bucket, other)."""
    low, high = F.least("bucket", "other"), F.greatest("bucket", "other")
    pairs = pairs.select(low.alias("a"), high.alias("b")).distinct().select(F.xxhash64("a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("bucket"))
    rows = placed.join(pairs, "bucket").select("pair", "bucket", "class", "times", "embedding").repartition("pair").sortWithinPartitions("pair", "bucket")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_bucket(batches, "pair"):
            batch = table.combine_chunks().to_batches()[0]
            bucket, times, x = batch.column("bucket").to_numpy(), batch.column("times").to_numpy(), one_length(batch)
            apart = bucket[:, None] != bucket[None]
            add = ((x @ x.T >= link) & apart) @ times
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(add)], names=["class", "add"])

    return rows.mapInArrow(look, "class long, add long").groupBy("class").agg(F.sum("add").alias("more"))


def counted(vecs: DataFrame, comp: DataFrame, link: float, scratch: Scratch) -> DataFrame:
    """class, comp, links to other classes' rows, for all classes in components."""
    members = vecs.join(bounded(comp), F.col("class") == F.col("node"))
    placed = scratch.save(laid_out(members, link), "placed")
    split = scratch.save(placed.groupBy("comp").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a <> b").select("comp"), "split")
    if split.isEmpty():
        return placed.select("class", "comp", F.col("own").alias("links"))
    several = placed.join(bounded(split), "comp", "left_semi")
    pairs = scratch.save(against(several, scratch.save(summaries(several), "summaries"), link, scratch), "pairs")
    whole = scratch.save(pairs.groupBy("bucket").agg(F.sum("add").alias("whole")), "whole")
    mixed = pairs.where("other is not null")
    more = scratch.save(compared(several, mixed, link), "compared") if not mixed.isEmpty() else None
    out = placed.select("class", "comp", "bucket", "own").join(bounded(whole), "bucket", "left")
    out = out.join(bounded(more), "class", "left") if more is not None else out.withColumn("more", F.lit(0))
    return out.select("class", "comp", (F.col("own") + F.coalesce("whole", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links"))


def near_duplicates(embeddings: DataFrame, link: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = Scratch(embeddings.sparkSession, "nn")
    good = vectors.whole(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), good.alias("good"), "embedding", F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("second"), "embedding"), "dim": F.size("embedding")}), "rows")
    many = rows.where("good").groupBy("h1", "h2").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.min("vec_id").alias("rep")).where("n > 1")
    many = scratch.save(many, "many-rows")
    classes = rows.where("good").join(bounded(many), ["h1", "h2"], "left")
    classes = classes.select("row", "vec_id", F.coalesce("first", "row").alias("class"), F.coalesce("n", F.lit(1)).alias("times"), F.when(F.col("n") > 1, F.col("rep")).otherwise(F.col("vec_id")).alias("rep"), "dim", "embedding")
    vecs = scratch.save(classes.where("row = class").select("class", "times", "rep", "dim", "embedding"), "classes")
    found = None
    # Lengths that two classes have: a few, each searched by itself.
    for dim in [r.dim for r in vecs.groupBy("dim").count().where("count > 1").orderBy("dim").collect()]:
        own = Scratch(embeddings.sparkSession, f"nn-{dim}")
        of_dim = vecs.where(F.col("dim") == dim).drop("dim")
        one = own.save(counted(of_dim, connected(of_dim, link, own), link, own), "counted")
        found = one if found is None else found.union(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named = found.join(vecs.select("class", "rep"), "class")
    first = scratch.save(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "first")
    named = scratch.save(named.join(bounded(first), "comp").select("class", "links", "component_id"), "named")
    out = rows.select("row", "vec_id", "good", "h1", "h2").join(bounded(many), ["h1", "h2"], "left")
    copied = F.col("good") & F.col("n").isNotNull()
    out = out.select("vec_id", F.when(copied, F.col("first")).otherwise(F.col("row")).alias("class"), F.when(copied, F.col("n") - 1).otherwise(F.lit(0)).alias("copies"), F.when(copied, F.col("rep")).otherwise(F.col("vec_id")).alias("alone"))
    out = out.join(bounded(named), "class", "left")
    n_links = (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links")
    component = F.when(F.col("links").isNull(), F.col("alone")).otherwise(F.col("component_id"))
    out = out.select("vec_id", n_links, component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0))


#: Every vector against every other; the search finds all links of tables as small as these.
ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
