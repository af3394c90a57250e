"""N-gram Jaccard self-join with R-trees over count vectors, and its connected components.

A text's set is its distinct word shingles. Hashing the shingles into a few groups and
counting each group gives a point; the sum of coordinate minima of two points bounds the
overlap of their sets from above, and so does it for the corners of two R-tree nodes.
Pairs that survive the bound are verified on the sets themselves.

One R-tree over a corpus would compare nearly everything, as no short vector separates
long texts. So exact keys deal the points out first: within a band of sizes, shingles are
hashed into more groups than two linked sets may differ in, so that such sets agree on
some whole group; a set emits the hashes of its groups that come first in one global
order, as many as a prefix filter needs. The sets of a key have an R-tree; pairs that it
lets through, directly or through others, make families, and no link leaves a family.

Equal sets are one class. A family's sets are brought together once, for an R-tree of their
own whose pairs are verified. Pairs of one component are skipped as soon as verified links
have joined them, and only the links that join components are given out, at most one a
class; so are a key's pairs. A group of n near copies has n rows in its family's task and
at most n - 1 after it, and no link between texts is lost. A key or a family too large for
a task is split into buckets, and each pair of buckets is a task (a cell) with an R-tree
for either side.

Hot keys are dealt by ranges of (key, class), so that one key can spread over many tasks;
keys that have the same classes count once.

Edge cases: null and empty texts and texts of white space have no shingles and stay
alone; a text with fewer words than a shingle is one shingle; a null doc_id is never a
component's id, unless the component has no other; rows that repeat a doc_id are rows of
their own with the same result; other columns are ignored. Shingles are told apart by 64
bits of hash, sets by 128.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import tokens
from foliary.llm.scratch import Scratch

#: Groups of a point: the smallest of 32, 64, 128, ... that have at most so many shingles each on
#: average. With a fixed number the counts of long texts would look alike.
GROUPS, IN_GROUP = 32, 8
#: Sets below this size use single shingles as keys.
SMALL = 24
BAND = 1.5
REMEMBERED = 200_000
#: Most classes, and most shingles, that a family's bucket has on average.
CELL = 4096
CELL_SHINGLES = 1 << 19
LEAF = 32
#: Pairs that are verified at once.
BATCH = 1 << 14
#: Classes of a key that are one leaf; such keys are looked through many at once.
FEW = 6
#: Bytes of a cell's table of shared shingles; beyond it sets are compared one by one.
TABLE_BYTES = 64 << 20
#: Bits of a key: a chance match only enlarges a family, and short keys shuffle cheaper.
KEY_BITS = 44
#: Rows of a few numbers that may be broadcast (at most 40 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of points that may be broadcast.
BROADCAST_BYTES = 8 << 20
U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + U(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def shingles(text: str | None, k: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles. bytes.lower and bytes.split know ASCII only."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.array([], dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(k, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        out = out * U(0xD6E8FEB86659FD93) + h[j : len(h) - size + 1 + j]
    return np.unique(mix(out))


class Limits:
    """The link condition den * overlap >= num * union, and what follows from it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differ(self, n: int) -> int:
        """Most shingles in which a set of n and a linked one differ, both sides together."""
        return (self.den - self.num) * n // self.num

    def missing(self, n: int) -> int:
        """Most of its n shingles that a linked set lacks."""
        return (self.den - self.num) * n // self.den

    def largest(self, n: int) -> int:
        return n * self.den // self.num

    def need(self, both: np.ndarray | int) -> np.ndarray | int:
        """The least overlap of linked sets with so many shingles together."""
        return -(-self.num * both // (self.den + self.num))

    def level(self, n: int) -> int:
        return 0 if n < SMALL else 1 + int(np.log(n / SMALL) / np.log(BAND) + 1e-9)

    def groups(self, level: int) -> int:
        return int(np.ceil(1.36 * (self.den - self.num) / self.num * SMALL * BAND**level))

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Linked sets that aren't equal share at least one of these."""
        n = len(s)
        if self.differ(n) == 0:
            return np.array([], dtype=np.uint64)
        out, single = [], False
        for level in sorted({self.level(n), self.level(self.largest(n))}):
            if level == 0:
                single = True
                continue
            m = self.groups(level)
            group = (mix(s, 1) % U(m)).astype(np.int64)
            sums = np.zeros(m, dtype=np.uint64)
            np.add.at(sums, group, mix(s, 2))
            used = np.flatnonzero(np.bincount(group, minlength=m))
            own = mix(sums[used] + used.astype(np.uint64) * U(0x9E3779B97F4A7C15), 100 + level)
            # Both sets have too few groups, or the other one finds this one.
            single = single or len(own) <= self.differ(n)
            out.append(np.sort(own)[: self.differ(n) + 1])
        if single:
            out.append(np.sort(mix(s, 3))[: self.missing(n) + 1])
        return np.unique(np.concatenate(out) & U((1 << KEY_BITS) - 1))


def bounded(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def set_hash(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(s, seed).sum(dtype=np.uint64).view(np.int64)) for seed in (5, 6))


def groups_of(n: int) -> int:
    return GROUPS << max(0, int(np.ceil(np.log2(max(n, 1) / (GROUPS * IN_GROUP)))))


def point(s: np.ndarray, groups: int) -> np.ndarray:
    """Groups are leading bits of a hash, so that two neighbours are one group of the next coarser point."""
    shift = U(64 - groups.bit_length() + 1)
    return np.bincount((mix(s, 4) >> shift).astype(np.int64), minlength=groups)


def coarser(points: list[np.ndarray], groups: int) -> np.ndarray:
    """Points of `groups` groups or more, at that many, as rows."""
    return np.array([p if len(p) == groups else p.reshape(groups, -1).sum(axis=1) for p in points], dtype=np.int32).reshape(-1, groups)


def longs(xs: list[np.ndarray]) -> pa.Array:
    return pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64()))


def measured(docs: DataFrame, k: int, limits: Limits) -> DataFrame:
    """row (a number of its own), doc_id, mark (the text's hash), n, hi, lo (the set's hash), point, keys of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = Words(), TaskContext.get().partitionId() << 36
        for batch in batches:
            own = [shingles(t, k, words) for t in tokens.columns(batch, "text")[0]]
            hi, lo = np.array([set_hash(s) for s in own], dtype=np.int64).reshape(-1, 2).T
            columns = [pa.array(np.arange(row, row + len(own))), batch.column("doc_id"), batch.column("mark"), pa.array(list(map(len, own)), pa.int64()), pa.array(hi), pa.array(lo)]
            columns += [pa.array([point(s, groups_of(len(s))).astype("<u4").tobytes() for s in own], pa.binary()), longs([limits.keys(s) for s in own])]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "mark", "n", "hi", "lo", "point", "keys"])
            row += len(own)
        words.clear()
        tokens.release()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(read, "row long, doc_id long, mark long, n long, hi long, lo long, point binary, keys array<long>")


def whole_runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool, bool]]:
    """Of sorted rows: columns of whole runs of equal `by`, where each run begins and the end, and
    whether the first run is the task's first and the last one its last."""
    held: list[pa.RecordBatch] = []
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy() for n in by]
        if held and all(held[-1].column(n)[-1].as_py() == k[-1] for n, k in zip(by, keys, strict=True)):
            held.append(batch)
            continue
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held or len(cut):
            last = int(cut[-1]) if len(cut) else 0
            table = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            if table.num_rows:
                yield (*columns_of(table, by), first, False)
                first = False
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield (*columns_of(pa.Table.from_batches(held).combine_chunks(), by), first, True)


def columns_of(table: pa.Table, by: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    own = [[np.frombuffer(x, "<u4") for x in c.to_pylist()] if pa.types.is_binary(c.type) else c.to_numpy() for c in table.columns]
    keys = [table.column(n).to_numpy() for n in by]
    return own, np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1, [table.num_rows]])


def shared_groups(dealt: DataFrame) -> DataFrame:
    """dealt: key, class -> group, class: the classes of each key that more than one has. Keys with
    the same classes are one group; a key that may go on in another task is one by itself."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, own), at, first, last in whole_runs(batches, "key"):
            size = np.diff(at)
            group = mix(np.add.reduceat(mix(own.view(np.uint64), 7), at[:-1]) + size.astype(np.uint64), 8).view(np.int64)
            edge = np.zeros(len(size), dtype=bool)
            edge[0], edge[-1] = first, last
            group[edge] = key[at[:-1][edge]]
            keep = np.repeat((size > 1) | edge, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(group, size)[keep]), pa.array(own[keep])], names=["group", "class"])

    spread = dealt.select("key", "class").repartitionByRange("key", "class").sortWithinPartitions("key", "class")
    return spread.mapInArrow(runs, "group long, class long").distinct()


def cells(rows: DataFrame, by: str, buckets: DataFrame) -> DataFrame:
    """rows with cell and bucket; buckets: a written table of those values of `by` that have several."""
    rows = rows.join(bounded(buckets), by, "left").withColumn("buckets", F.coalesce("buckets", F.lit(1)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("class"), "buckets").cast("long"))
    other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1), lambda x: F.least("bucket", x) * F.lit(1 << 31) + F.greatest("bucket", x))
    return rows.withColumn("cell", F.explode(other)).drop("buckets")


def family_edges(shared: DataFrame, classes: DataFrame, limits: Limits, scratch: Scratch) -> DataFrame:
    """Of the classes of each group, pairs (a, b) whose points allow a link: enough of them to
    connect all that such pairs connect."""
    counts = shared.groupBy("group").agg(F.ceil(F.count("*") / CELL).cast("long").alias("buckets")).where("buckets > 1")
    rows = cells(shared, "group", scratch.save(counts, "large-groups"))
    wanted = scratch.save(classes.select("class", "n", "point").join(shared.select("class").distinct(), "class"), "points")
    size = wanted.agg(F.sum(F.octet_length("point") + 16)).first()[0] or 0
    wanted = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    rows = rows.join(wanted, "class").select("group", "cell", "bucket", "class", "n", "point")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, bucket, own, n, points), at, _, _ in whole_runs(batches, "group", "cell"):
            size = np.diff(at)
            block = np.repeat(np.arange(len(size)), size)
            found, fine = [np.zeros((0, 2), dtype=np.int64)], np.array(list(map(len, points)))
            for step in range(1, FEW):
                i = np.flatnonzero((block[step:] == block[:-step]) & (size[block[step:]] <= FEW))
                j = i + step
                alike = np.minimum(n[i], n[j]) * limits.den >= np.maximum(n[i], n[j]) * limits.num
                i, j = i[alike], j[alike]
                for g in np.unique(groups := np.minimum(fine[i], fine[j])):
                    x, y = i[groups == g], j[groups == g]
                    rows_, where = np.unique(np.concatenate([x, y]), return_inverse=True)
                    table = coarser([points[r] for r in rows_], g)
                    overlap = np.minimum(table[where[: len(x)]], table[where[len(x) :]]).sum(axis=1)
                    good = overlap >= limits.need(n[x] + n[y])
                    found.append(np.stack([own[x[good]], own[y[good]]], axis=1))
            for k in np.flatnonzero(size > FEW):
                part = slice(at[k], at[k + 1])
                side = bucket[part] if len(np.unique(bucket[part])) > 1 else None
                pairs = connecting(tree_pairs(coarser(points[part], fine[part].min()), n[part], comp := np.arange(size[k]), limits, side), comp)
                found.append(own[part][np.array(pairs, dtype=np.int64).reshape(-1, 2)])
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.repartition("group", "cell").sortWithinPartitions("group", "cell").mapInArrow(look, "a long, b long").distinct()


# --- the R-tree -----------------------------------------------------------------


class Node:
    """A box of points by its upper corner and its smallest and largest set."""

    def __init__(self, rows: np.ndarray, children: list[Node], points: np.ndarray, n: np.ndarray):
        self.rows, self.children = rows, children
        self.corner = points[rows].max(axis=0)
        self.least, self.most = int(n[rows].min()), int(n[rows].max())


def bulk_load(rows: np.ndarray, points: np.ndarray, n: np.ndarray) -> Node:
    """Sort-tile: runs of like sizes, then runs along the widest coordinate, then leaves."""

    def build(rows: np.ndarray, depth: int) -> Node:
        if len(rows) <= LEAF:
            return Node(rows, [], points, n)
        if depth == 0:
            rows = rows[np.argsort(n[rows], kind="stable")]
        else:
            rows = rows[np.argsort(points[rows][:, points[rows].var(axis=0).argmax()], kind="stable")]
        parts = np.array_split(rows, min(8, -(-len(rows) // LEAF)))
        return Node(rows, [build(p, depth + 1) for p in parts], points, n)

    return build(rows, 0)


def tree_pairs(points: np.ndarray, n: np.ndarray, comp: np.ndarray, limits: Limits, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j), some at a time, whose points allow the overlap they need and whose
    components differ; comp may change between them. With sides, pairs of rows of both."""
    sides = [np.arange(len(n))] if side is None else [np.flatnonzero(side == x) for x in np.unique(side)]
    if side is not None and len(sides) < 2:
        return
    trees = [bulk_load(rows, points, n) for rows in sides]
    todo = [(trees[0], trees[-1])]
    while todo:
        a, b = todo.pop()
        if a.least > limits.largest(b.most) or b.least > limits.largest(a.most):
            continue
        if np.minimum(a.corner, b.corner).sum() < limits.need(a.least + b.least):
            continue
        if not a.children and not b.children:
            own = comp[a.rows][:, None] != comp[b.rows][None]
            if not own.any():
                continue
            overlap = np.minimum(points[a.rows][:, None], points[b.rows][None]).sum(axis=2)
            x, y = n[a.rows][:, None], n[b.rows][None]
            good = own & (overlap >= limits.need(x + y)) & (np.minimum(x, y) * limits.den >= np.maximum(x, y) * limits.num)
            i, j = np.nonzero(np.triu(good, 1) if a is b else good)
            if len(i):
                yield a.rows[i], b.rows[j]
        elif a is b:
            todo += [(c, d) for k, c in enumerate(a.children) for d in a.children[k + 1 :]]
            todo += [(c, c) for c in a.children]  # these come first
        elif a.children and (not b.children or len(a.rows) >= len(b.rows)):
            todo += [(c, b) for c in a.children]
        else:
            todo += [(a, c) for c in b.children]


def overlaps(flat: np.ndarray, n: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """flat: sets one after another, n: their sizes -> the exact overlaps of pairs (i, j) of sets."""
    who = np.repeat(np.arange(len(n)), n)
    _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    width = max(1, -(-int(shared.sum()) // 64))
    if len(n) * width * 8 > TABLE_BYTES:
        sets = np.split(flat, np.cumsum(n)[:-1])
        return lambda i, j: np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], dtype=np.int64)
    table, used = np.zeros((len(n), width), dtype=np.uint64), shared[which]
    column = (np.cumsum(shared) - 1)[which[used]]
    np.bitwise_or.at(table, (who[used], column >> 6), U(1) << (column & 63).astype(np.uint64))
    step = max(1, (8 << 20) // (8 * width))

    def count(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [np.bitwise_count(table[i[k : k + step]] & table[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    return count


def connecting(pairs: Iterator[tuple[np.ndarray, np.ndarray]], comp: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join components; comp keeps up with them."""
    out = []
    for i, j in pairs:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if comp[x] != comp[y]:
                comp[comp == comp[y]] = comp[x]
                out.append((x, y))
    return out


def joining_links(sets: list[np.ndarray], limits: Limits, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, with sides only between those of both, that join all which links connect: a forest."""
    n, flat = np.array(list(map(len, sets))), np.concatenate(sets)
    groups = groups_of(int(n.mean()))
    points = np.array([point(s, groups) for s in sets], dtype=np.int32)
    overlap, comp = overlaps(flat, n), np.arange(len(n))

    def verified() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = tree_pairs(points, n, comp, limits, side)
        while True:
            pair = next(pairs, None)
            if pair is not None:
                waiting.append(pair)
            if waiting and (pair is None or sum(len(x) for x, _ in waiting) >= BATCH):
                i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting.clear()
                apart = comp[i] != comp[j]
                i, j = i[apart], j[apart]
                both = overlap(i, j)
                good = limits.den * both >= limits.num * (n[i] + n[j] - both)
                yield i[good], j[good]
            if pair is None:
                return

    return connecting(verified(), comp)


def search(rows: DataFrame, k: int, limits: Limits) -> DataFrame:
    """rows: family, cell, bucket, class, text, sorted by family and cell -> links a, b."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Words(), []

        def one_by_one():
            for batch in batches:
                yield from zip(*tokens.columns(batch, "family", "cell", "bucket", "class", "text"), strict=True)

        send = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        for _, own in groupby(one_by_one(), key=lambda r: r[:2]):
            sets = {(r[3], r[2]): shingles(r[4], k, words) for r in own}  # rows may repeat a class
            classes, bucket = np.array(list(sets)).T
            links = joining_links(list(sets.values()), limits, bucket if len(np.unique(bucket)) > 1 else None)
            found += [(classes[i], classes[j]) for i, j in links]
            if len(found) >= 10_000:
                yield send()
                found.clear()
        if found:
            yield send()
        words.clear()
        tokens.release()

    return rows.mapInArrow(look, "a long, b long")


# --- components -----------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, comp (its smallest reachable node) of all nodes with edges (a, b), by alternating
    large and small stars. Every round is a written table, and so are its minima: a join
    with them can be a broadcast, or have the rows of a hub dealt to several tasks."""
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{label}-0")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, k = state(edges), 0
    while now[0]:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = scratch.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{label}-least-{k}")
        large = both.where("v > u").join(bounded(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{label}-large-{k}")
        # All v are below u now; hang u and its others under the smallest.
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-small-{k}")
        joined = large.join(bounded(least), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.save(small, f"{label}-{k + 1}")
        before, now = now, state(edges)
        scratch.drop(f"{label}-{k}", f"{label}-least-{k}", f"{label}-large-{k}", f"{label}-small-{k}")
        k += 1
        if tuple(before) == tuple(now):
            break
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(tops)


# --- the join -------------------------------------------------------------------


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return linked(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def linked(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, mark, n, hi, lo, component_id, comp (a number of the component's own) of every row;
    the last two are null for rows without shingles."""
    limits, scratch = Limits(num, den), Scratch(docs.sparkSession, "jaccard")
    whole = scratch.save(measured(docs, k, limits), "whole")
    rows = scratch.save(whole.drop("keys", "point"), "rows")
    # A class is one set; its first row gives it a number and a text.
    first = F.min(F.struct("row", "doc_id", "mark", "point")).alias("first")
    classes = whole.drop("keys").where("n > 0").groupBy("n", "hi", "lo").agg(first, F.min("doc_id").alias("rep"))
    classes = scratch.save(classes.select("n", "hi", "lo", F.col("first.row").alias("class"), F.col("first.doc_id").alias("own_id"), F.col("first.mark").alias("own_mark"), F.col("first.point").alias("point"), "rep"), "classes")
    copies = scratch.save(rows.where("n > 0").select("row").join(classes.select(F.col("class").alias("row")), "row", "left_anti"), "copies")
    dealt = whole.select("row", "keys").join(bounded(copies), "row", "left_anti").select(F.col("row").alias("class"), F.explode("keys").alias("key"))
    shared = scratch.save(shared_groups(dealt), "shared")
    scratch.drop("whole", "copies")
    edges = scratch.save(family_edges(shared, classes, limits, scratch), "edges")
    scratch.drop("shared", "large-groups", "points")
    family = scratch.save(components(edges, scratch, "a").toDF("class", "family"), "family")
    links = scratch.save(search(family_cells(docs, family, classes, scratch), k, limits), "links")
    comp = scratch.save(components(links, scratch, "b").toDF("class", "comp"), "comp")
    scratch.drop("edges", "family", "wanted", "links")
    named = classes.select("n", "hi", "lo", "class", "rep").join(bounded(comp), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    named = scratch.save(named, "named")
    smallest = scratch.save(named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size"), "smallest")
    named = named.join(bounded(smallest), "comp", "left").select("n", "hi", "lo", F.coalesce("component_id", "rep").alias("component_id"), "comp")
    return rows.select("doc_id", "mark", "n", "hi", "lo").join(named, ["n", "hi", "lo"], "left")


def family_cells(docs: DataFrame, family: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """family, cell, bucket, class, text of the classes (class, family), for `search`."""
    wanted = scratch.save(family.join(classes.select("class", "n", "own_id", "own_mark"), "class"), "wanted")
    sizes = wanted.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum("n") / CELL_SHINGLES)).cast("long").alias("buckets"))
    large = scratch.save(sizes.where("buckets > 1"), "large")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("m"), "text")
    rows = texts.join(bounded(wanted), F.expr("m = own_mark and d <=> own_id")).select("family", "class", "text")
    return cells(rows, "family", large).repartition("family", "cell").sortWithinPartitions("family", "cell")


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs of which one of each component stays, the one with the smallest doc_id.

    Rows are told apart by doc_id and text, so other texts of a dropped row's doc_id are judged
    by themselves; a null doc_id comes last; of several texts of one doc_id in a component the
    set's hash decides, and then the text's; of rows that repeat both, one stays. Rows without
    shingles all stay.
    """
    scratch = Scratch(docs.sparkSession, "near")
    found = linked(docs, k, num, den).where("n > 0")
    found = found.select("comp", F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "n", "hi", "lo", "mark").alias("row"))
    found = scratch.save(found.groupBy("comp", "row").agg(F.count("*").alias("times")), "found")
    first = found.groupBy("comp").agg(F.min("row").alias("first"), F.sum("times").alias("size")).where("size > 1").drop("size")
    judged = found.join(bounded(scratch.save(first, "first")), "comp").select(F.col("row.doc_id").alias("__id"), F.col("row.mark").alias("__mark"), "times", (F.col("row") == F.col("first")).alias("stays"))
    gone = scratch.save(judged.where("not stays").select("__id", "__mark"), "gone")
    twice = scratch.save(judged.where("stays and times > 1").select("__id", "__mark"), "twice")
    scratch.drop("found", "first")

    def narrowed(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        same = df["doc_id"].cast("long").eqNullSafe(rows["__id"]) & (F.xxhash64(df["text"]) == rows["__mark"])
        return df.join(bounded(rows), same, how)

    kept = narrowed(docs, gone, "left_anti")
    if twice.isEmpty():
        return kept
    return narrowed(kept, twice, "left_anti").union(narrowed(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w)),
n AS (SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = n.doc_id
"""
