"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of token ids. A window of `window` ids gives every queue its
target proportion; what a queue is owed beyond whole ids is its deficit, carried to the
next window. A queue that has run dry gives its share to the others in proportion.

Deficits have a closed form: at virtual time v, queue s with weight p and T ids is owed
min(p v, T) and has been served that number rounded. The v at which all queues together
have been served n ids is found by bisection, so any task can tell what any window holds
from the queues' totals alone: deficits carry across partitions without passing state,
and no queue, however hot, is walked by one task.

Windows are laid out one after another, in each the runs of its queues, and cut into
sequences of `length` ids. Every sequence but the last is full; a document is cut where
a window's share or a sequence ends.

Edge cases: null and empty texts are one id; a null source is the queue ''; null and
repeated doc_ids are documents like any other; other columns are ignored; an empty table
gives no pieces.

More sources than `max_lanes` are the leaves of a tree, dealt out by hashes: at every node the
children take turns, as queues do. A node's own window is what it is given of one of the root's, so
that every window still has all sources in proportion; but it is never below `LEAST_RUN` ids for each
child, so that very small sources come in runs of about so many, every few windows, and their
deficits are carried till then. A document's place is found node by node, from its source to the root, each with the totals of
its own children only: the cost of a document grows with the depth, the logarithm of the number of
sources, and no task or driver holds all totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm import tokens
from foliary.llm.scratch import Scratch

LENGTH = 1024
WINDOW = 64 * LENGTH
#: (shard, source) offsets that may be broadcast (about 40 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Ids that a node's child is given at a turn, if all are alike, at least.
LEAST_RUN = 64
#: Nodes whose totals a task keeps.
REMEMBERED = 4096
PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@dataclass
class Runs:
    """Stretches of documents: which one, where in it, the place in a queue, how long."""

    doc: np.ndarray
    done: np.ndarray
    begin: np.ndarray
    size: np.ndarray


class Rounds:
    """What deficit round-robin has served each queue, as a function of the ids served in all."""

    def __init__(self, totals: list[int], weights: list[float]):
        self.totals = np.array(totals, dtype=np.float64)
        self.weights = np.array(weights, dtype=np.float64) / sum(weights)
        self.latest = float(((self.totals + 1) / self.weights).max())
        # Without rounding, queues run dry in this order, and between two of these times the rest grow evenly.
        dry = self.totals / self.weights
        order = np.argsort(dry, kind="stable")
        self.dry = dry[order]
        self.gone = np.concatenate([[0.0], np.cumsum(self.totals[order])])
        self.left = np.concatenate([np.cumsum(self.weights[order][::-1])[::-1], [0.0]])
        self.at_dry = self.gone[:-1] + self.dry * self.left[:-1]

    def _at(self, v: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(v[:, None] * self.weights + 0.5), self.totals).astype(np.int64)

    def _near(self, n: np.ndarray) -> np.ndarray:
        """The time at which n ids would have been served without rounding."""
        k = np.minimum(np.searchsorted(self.at_dry, n, side="left"), len(self.dry) - 1)
        return np.clip((n - self.gone[k]) / self.left[k], 0, self.latest)

    def served(self, n: np.ndarray) -> np.ndarray:
        """Rows of ids by queue, each row summing to its n. Never falls as n grows."""
        slack = len(self.totals) / 2 + 1  # what rounding can add or take away
        low, high = self._near(n - slack), self._near(n + slack)
        low = np.where(self._at(low).sum(axis=1) < n, low, 0.0)
        high = np.where(self._at(high).sum(axis=1) >= n, high, self.latest)
        while True:
            mid = (low + high) / 2
            # Between the two nothing but one id is served, or no time is left between them.
            apart = self._at(high).sum(axis=1) - self._at(low).sum(axis=1) > 1
            if not (apart & (mid > low) & (mid < high)).any():
                break
            enough = self._at(mid).sum(axis=1) >= n
            high, low = np.where(enough, mid, high), np.where(enough, low, mid)
        base, top = self._at(low), self._at(high)
        room = top - base
        before = np.cumsum(room, axis=1) - room
        return base + np.clip((n - base.sum(axis=1))[:, None] - before, 0, room)

    def around(self, queue: int, place: int) -> int:
        """About how many ids all queues have been served when this id of a queue is."""
        return int(self._at(np.array([(place + 0.5) / self.weights[queue]]))[0].sum())


def cut(rounds: Rounds, queue: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int, length: int) -> list[list[tuple[int, int, int, int]]]:
    """Of each document, at `begin` in its queue: pieces (start in it, length, sequence, offset)."""
    total = int(rounds.totals.sum())
    spans = [(rounds.around(q, b) // window, rounds.around(q, b + n - 1) // window) for q, b, n in zip(queue, begin, size, strict=True)]
    slack = 2 + len(rounds.totals) // window
    wanted = np.unique(np.concatenate([np.arange(max(0, a - slack), b + slack + 2) for a, b in spans]))
    served = rounds.served(np.minimum(wanted * window, total))
    where = {int(w): i for i, w in enumerate(wanted)}
    out = []
    for (first, last), q, b, n in zip(spans, queue, begin, size, strict=True):
        pieces, done = [], 0
        lo = where[max(0, first - slack)]
        hi = where[last + slack + 1]
        marks = served[lo : hi + 1, q]
        w = lo + int(np.searchsorted(marks, b, side="right")) - 1
        while done < n:
            while served[w + 1, q] <= b + done:
                w += 1
            ahead = int((served[w + 1, :q] - served[w, :q]).sum())  # queues before this one in the window
            at = int(wanted[w]) * window + ahead + (b + done - int(served[w, q]))
            run = min(n - done, int(served[w + 1, q]) - (b + done))
            while run > 0:
                take = min(run, length - at % length)
                pieces.append((done, take, at // length, at % length))
                done, at, run = done + take, at + take, run - take
        out.append(pieces)
    return out


def write_queues(docs: DataFrame, scratch: Scratch, tokenizer: str, end: int = 0, remembered: int | None = None) -> DataFrame:
    """Every document's ids, and the ids of its source before it in its shard. Shards follow
    the input's partitions, so no text is shuffled."""
    dtype = "<u2" if tokens.vocabulary_size(tokenizer) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, so_far = TaskContext.get().partitionId(), {}
        for batch in batches:
            doc_ids, sources, texts = tokens.columns(batch, "doc_id", "source", "text")
            ids, ahead = tokens.encode(texts, tokenizer, end, remembered=remembered), []
            for source, x in zip(sources, ids, strict=True):
                ahead.append(so_far.get(source, 0))
                so_far[source] = ahead[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(sources, pa.string()), pa.array(ahead, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array([x.astype(dtype).tobytes() for x in ids], pa.binary())],
                names=["shard", "doc_id", "source", "ahead", "n_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return scratch.save(rows.mapInArrow(write, "shard int, doc_id long, source string, ahead long, n_tokens long, ids binary"), "queues")


def weighted(sources: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """source, n, weight."""
    if not weights:
        return sources.withColumn("weight", F.col("n").cast("double"))
    floor = min([w for w in weights.values() if w > 0], default=1.0) / 1000  # a queue without a weight comes last
    named = sources.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
    return sources.join(named, "source", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(floor)))


def tree(sources: DataFrame, n_sources: int, max_lanes: int, scratch: Scratch, window: int = WINDOW) -> tuple[int, DataFrame, list[DataFrame]]:
    """depth, the path (node1, node2, ...) of each source, and below the root for each level its nodes with
    their children (name, n, weight), about max_lanes each, and windows."""
    depth = 1
    while max_lanes**depth < n_sources:
        depth += 1
    digit = lambda k: F.pmod(F.xxhash64("source", F.lit(k)), F.lit(max_lanes)).cast("string")
    paths = sources.withColumn("node0", F.lit(""))
    for k in range(1, depth):
        paths = paths.withColumn(f"node{k}", F.concat_ws("/", F.col(f"node{k - 1}"), digit(k)))
    paths = scratch.save(paths, "paths")
    levels, total = [], paths.agg(F.sum("weight")).first()[0] or 1.0
    for k in range(depth):
        below = F.col("source") if k == depth - 1 else F.col(f"node{k + 1}")
        children = paths.groupBy(F.col(f"node{k}").alias("node"), below.alias("name")).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
        own = F.round(F.sum("weight") / F.lit(total) * window).cast("long")
        nodes = children.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("name", "n", "weight"))).alias(f"children{k}"), F.greatest(own, F.count("*") * LEAST_RUN).alias(f"window{k}"))
        levels.append(scratch.save(nodes.withColumnRenamed("node", f"node{k}"), f"level-{k}"))
    return depth, paths.select("source", *[f"node{k}" for k in range(1, depth)]), levels


class Node:
    """The queues of a node, by name."""

    def __init__(self, children: list[dict], window: int):
        self.window = window
        self.place = {c["name"]: k for k, c in enumerate(children)}
        self.rounds = Rounds([c["n"] for c in children], [c["weight"] for c in children])


def pack(docs: DataFrame, tokenizer: str | None = None, weights: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW, max_lanes: int = 64, remembered: int | None = None) -> DataFrame:
    """Pieces of all documents in sequences. weights: target proportions by source; by
    default the sources' token shares, so that every window mixes as the whole does. remembered:
    see tokens.encode."""
    tokenizer, scratch = tokenizer or tokens.default_path(), Scratch(docs.sparkSession, "packing")
    queues = write_queues(docs, scratch, tokenizer, remembered=remembered)
    dtype = "<u2" if tokens.vocabulary_size(tokenizer) <= 1 << 16 else "<u4"
    parts = scratch.save(queues.groupBy("shard", "source").agg(F.sum("n_tokens").alias("n")), "parts")
    sources = parts.groupBy("source").agg(F.sum("n").alias("n"))
    depth, paths, levels = tree(weighted(sources, weights), sources.count(), max_lanes, scratch, window)
    top = [c.asDict() for r in levels[0].collect() for c in r["children0"]]  # the root's children, about max_lanes
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("shard", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before"))
    offsets = F.broadcast(offsets) if parts.count() <= BROADCAST_ROWS else offsets
    rows = queues.join(offsets, ["shard", "source"])
    if depth > 1:
        rows = rows.join(paths, "source")
    for k in range(1, depth):
        rows = rows.join(levels[k], f"node{k}")
    keys = ["", *[f"node{k}" for k in range(1, depth)], "source"]

    def up(batch: pa.RecordBatch, level: int, names: list[list[str]], runs: Runs, known: dict[str, Node]) -> Runs:
        """Runs in the queues of a level's nodes as runs in the queues that the nodes are."""
        groups: dict[str, list[int]] = {}
        for i, doc in enumerate(runs.doc.tolist()):
            groups.setdefault(names[level][doc], []).append(i)
        out = []
        for name, own in groups.items():
            if name not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                row = int(runs.doc[own[0]])
                known[name] = Node(batch.column(f"children{level}")[row].as_py(), batch.column(f"window{level}")[row].as_py())
            node = known[name]
            queue = np.array([node.place[names[level + 1][runs.doc[i]]] for i in own])
            for i, found in zip(own, cut(node.rounds, queue, runs.begin[own], runs.size[own], node.window, 1 << 62), strict=True):
                out += [(runs.doc[i], runs.done[i] + done, at, take) for done, take, _, at in found]
        return Runs(*map(np.array, zip(*out, strict=True)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, known = Node(top, window), {}
        for batch in batches:
            doc_ids, ahead, sizes, payload, first = tokens.columns(batch, "doc_id", "ahead", "n_tokens", "ids", "before")
            if not doc_ids:
                continue
            names = [[""] * len(doc_ids), *tokens.columns(batch, *keys[1:])]
            n = len(doc_ids)
            runs = Runs(np.arange(n), np.zeros(n, dtype=np.int64), np.array(first) + np.array(ahead), np.array(sizes))
            for level in range(depth - 1, 0, -1):
                runs = up(batch, level, names, runs, known)
            queue = np.array([root.place[names[1][doc]] for doc in runs.doc.tolist()])
            rows, ids = [], [np.frombuffer(raw, dtype).astype("<u4") for raw in payload]
            for k, offset_in, own in zip(runs.doc.tolist(), runs.done.tolist(), cut(root.rounds, queue, runs.begin, runs.size, root.window, length), strict=True):
                for start, take, sequence, offset in own:
                    start += offset_in
                    rows.append((doc_ids[k], start, take, zlib.crc32(ids[k][start : start + take].tobytes()), sizes[k], sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=PIECES)

    return rows.mapInArrow(pieces, ", ".join(f"{x} long" for x in PIECES))
