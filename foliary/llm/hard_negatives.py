"""Hard negatives by blocked dense products of anchors and candidates.

Anchors are dealt into blocks of a fixed number of rows. For each block, a first pass over all
candidates multiplies the block, which tasks have as a broadcast, with their own rows, label by
label, and gives each anchor's best rows of its own label; those of all tasks merge by rank.
The second pass has the block with its positives, and gives for each of them the best rows of
other labels whose score lies in the positive's window. Products are of integers: exact in
doubles below 2^53, and in longs beyond it. Nothing but a block and its few positives passes
through the driver, however many anchors there are.

Ranks are exact with ties: a task sorts its candidates by vec_id and takes the first largest
score again and again.

Edge cases: rows with a null vec_id, label or vector, an empty vector, or a null or non-finite
component take no part, nor do those whose scaled squared norm is 2^60 or more, as scores are
longs. Of rows that repeat a vec_id the smallest (label, vector) takes part. Vectors of
different lengths have no score and are never compared. Anchors without positives, and
positives without a row in their window, give no row. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import vectors
from foliary.llm.scratch import Scratch

#: Anchors of a block: 8 MB of doubles at 64 components.
BLOCK = 16_384
#: Scores that a task holds at once.
SCORES = 1 << 21
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def one_row_each(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: vec_id, label, embedding, of which one for each vec_id; only repeated ones are shuffled."""
    again = scratch.save(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "again")
    if again.isEmpty():
        return rows
    first = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("first"))
    return rows.join(again, "vec_id", "left_anti").union(first.select("vec_id", "first.label", "first.embedding"))


def usable(embeddings: DataFrame, relabel_every: int, classes: int) -> DataFrame:
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.whole(F.col("embedding")))
    label = F.col("label").cast("long")
    if relabel_every:
        label = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % classes).otherwise(label)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")


def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and integer vectors, by length and in order of ids."""
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    for rows, m in vectors.scaled(batch.column("embedding")):
        order = np.argsort(ids[rows], kind="stable")
        yield ids[rows][order], labels[rows][order], m[order]


def best(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and the column of their largest score, k times over; -inf counts as none. Overwrites scores."""
    rows = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        good = scores[rows, at] > -np.inf
        if not good.any():
            return
        yield rows[good], at[good]
        scores[rows, at] = -np.inf


def tiles(n: int, width: int) -> Iterator[slice]:
    step = max(1, SCORES // max(1, width))
    return (slice(k, k + step) for k in range(0, n, step))


def positives_pass(block: Broadcast, k: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ids, labels, m in parts(batch):
                for own_ids, own_labels, own in (x for x in block.value if x[2].shape[1] == m.shape[1]):
                    for label in np.intersect1d(labels, own_labels):
                        there, mine = np.flatnonzero(labels == label), np.flatnonzero(own_labels == label)
                        for tile in tiles(len(mine), len(there)):
                            rows = mine[tile]
                            exact = vectors.products(own[rows], m[there])
                            scores = exact.astype(np.float64) if exact.dtype != np.float64 else exact.copy()
                            scores[own_ids[rows][:, None] == ids[there][None]] = -np.inf
                            if exact.dtype == np.float64:
                                picked = [(r, c) for r, c in best(scores, k)]
                            else:
                                picked = exactly(exact, scores > -np.inf, k)
                            found += [(own_ids[rows[r]], ids[there[c]], exact[r, c].astype(np.int64)) for r, c in picked]
            yield arrays(found, ["anchor_id", "positive_id", "positive_score"])

    return look


def exactly(scores: np.ndarray, may: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Like best, for longs that doubles can't tell apart."""
    out = []
    for r in range(len(scores)):
        columns = np.flatnonzero(may[r])
        order = columns[np.argsort(-scores[r, columns], kind="stable")[:k]]
        out.append((np.full(len(order), r), order))
    return out


def negatives_pass(block: Broadcast, k: int, least: int, most: int):
    """block: parts with a list of (row, positive_id, positive_score) arrays for each."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ids, labels, m in parts(batch):
                for own_ids, own_labels, own, row, positive, score in block.value:
                    if own.shape[1] != m.shape[1]:
                        continue
                    for tile in tiles(len(row), len(ids)):
                        rows, scores = row[tile], score[tile]
                        unique, which = np.unique(rows, return_inverse=True)
                        exact = vectors.products(own[unique], m)
                        other = (own_labels[unique][:, None] != labels[None])[which]
                        exact = exact[which]
                        low, high = -percent(-scores, least), percent(scores, most)
                        may = other & (exact >= low[:, None]) & (exact <= high[:, None])
                        picked = best(np.where(may, exact, -np.inf), k) if exact.dtype == np.float64 else exactly(exact, may, k)
                        found += [(own_ids[rows[r]], positive[tile][r], scores[r], ids[c], exact[r, c].astype(np.int64)) for r, c in picked]
            yield arrays(found, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return look


def percent(score: np.ndarray, p: int) -> np.ndarray:
    """floor(p * score / 100), without products that leave the longs."""
    return score // 100 * p + score % 100 * p // 100


def arrays(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)


def ranked(rows: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
    """The first k rows of each `by`: tasks drop all but their own first k before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, every: int = 50, relabel_every: int = 7, classes: int = 10, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int] = (50, 95), block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`; `window` holds the least and the
    most score of a negative in percent of its positive's.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = one_row_each(usable(embeddings, relabel_every, classes), scratch)
    anchors = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-anchors.count() // block))
    anchors = scratch.save(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "anchors")
    schema = "anchor_id long, positive_id long, positive_score long"
    out = None
    for b in range(blocks):
        table = anchors.where(F.col("block") == b).drop("block").toArrow().combine_chunks()
        own = [p for batch in table.to_batches() for p in parts(batch)]
        sent = spark.sparkContext.broadcast(own)
        found = rows.mapInArrow(positives_pass(sent, n_positives), schema)
        found = ranked(found, ["anchor_id"], "positive_score", "positive_id", n_positives).drop("rank").toArrow()
        sent = spark.sparkContext.broadcast([(*p, *windows_of(p[0], found)) for p in own])
        wanted = rows.mapInArrow(negatives_pass(sent, n_negatives, *window), f"{schema}, negative_id long, negative_score long")
        wanted = ranked(wanted, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives).select(*OUT)
        if blocks == 1:
            return wanted
        wanted.write.mode("append").parquet(f"{scratch.root}/found")
        sent.unpersist()
        out = wanted.schema
    return spark.read.schema(out).parquet(f"{scratch.root}/found")


def windows_of(ids: np.ndarray, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row in ids, positive_id, positive_score of a block's positives."""
    anchor, positive, score = (found.column(n).to_numpy() for n in ("anchor_id", "positive_id", "positive_score"))
    mine = np.isin(anchor, ids)
    anchor, positive, score = anchor[mine], positive[mine], score[mine]
    row = np.searchsorted(ids, anchor)
    order = np.argsort(row, kind="stable")
    return row[order], positive[order], score[order]


#: Below 2^53 doubles are exact, as in the operator.
ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""
