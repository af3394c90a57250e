"""Exact duplicates, screened by static binary-fuse filters.

Texts are equal when they are identical after their ASCII white space is deleted;
null counts as empty. An immutable snapshot of known texts carries one binary-fuse
filter (Graf and Lemire 2022) per bucket of its digests. Digests of an incoming
batch are grouped among themselves, then screened: a negative is certainly new and meets
the snapshot no more; a positive joins the snapshot's exact bucket, its bytes are compared,
and if they are equal the two groups are one.

Edge cases: null and empty texts (and those of white space only) form one group;
a null doc_id is kept only where no other row of its group is as long; rows that
repeat a doc_id within one group are one document, and all of them say kept;
a digest that collides without equal bytes stays two groups; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.scratch import Scratch

WHITE = r"[\x20\x09-\x0D]+"
#: Digests in one filter: about 1.2 MB of 8-bit fingerprints.
KEYS_PER_FILTER = 1_000_000
#: Classes of a batch that a filter is asked about in one task.
KEYS_PER_PROBE = 250_000
#: Rows of representatives that may be broadcast (about 12 MB); beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (of the original), sha (hex of the normalised text)."""
    return docs.select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(normalized(F.col("text")).cast("binary"), 256).alias("sha"),
    )


def best(n_chars: str = "n_chars", doc_id: str = "doc_id") -> Column:
    """The smallest of these is the row that stays: longest text, then smallest doc_id, null last."""
    return F.struct((-F.col(n_chars)).alias("minus"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"))


def classes(digest_rows: DataFrame) -> DataFrame:
    """One row per digest: how many rows it has and the best of them."""
    return digest_rows.groupBy("sha").agg(F.count("*").alias("n"), F.min(best()).alias("best"))


# --- the filter ---------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of each key, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, fingerprints) over 64-bit keys; repeated keys count once."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    segment = 1 << min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    capacity = int(round(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))))
    segments = max(1, -(-capacity // segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        slots = _slots(h, segment, segments)
        # Peel waves: a slot that one remaining key touches decides that key. Xors of the
        # remaining keys' indices name the key without lists.
        count = np.bincount(slots.ravel(), minlength=size)
        who = np.zeros(size, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(who, row, np.arange(len(keys)))
        waves, left, single = [], len(keys), np.flatnonzero(count == 1)
        while len(single):
            key, at = np.unique(who[single], return_index=True)
            waves.append((key, single[at]))
            left -= len(key)
            touched = slots[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(who, touched, np.tile(key, 3))
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if left:
            continue
        table = np.zeros(size, dtype=np.uint8)
        prints = _print(h)
        for key, own in reversed(waves):
            table[own] = 0
            table[own] = prints[key] ^ np.bitwise_xor.reduce(table[slots[:, key]], axis=0)
        return seed, segment, segments, table
    raise RuntimeError("no seed peels these keys")


def probe_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: np.ndarray) -> np.ndarray:
    """True for every key that was built in, and for about 1 of 256 others."""
    h = _mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return np.bitwise_xor.reduce(table[_slots(h, segment, segments)], axis=0) == _print(h)


def _keys(sha: pd.Series) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in sha], dtype=np.uint64)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring("sha", 17, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def build_filters(snapshot: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> tuple[DataFrame, int]:
    """One filter row per bucket of a snapshot's classes. The buckets follow the snapshot's
    size, so each filter has a bounded number of keys and none is ever rebuilt."""
    buckets = max(1, -(-snapshot.count() // keys_per_filter))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, table = build_filter(_keys(pdf["sha"]))
        return pd.DataFrame([(pdf["bucket"].iloc[0], seed, segment, segments, table.tobytes())], columns=["bucket", "seed", "segment", "segments", "prints"])

    rows = snapshot.select("sha", _bucket(buckets).alias("bucket")).groupBy("bucket")
    return rows.applyInPandas(build, "bucket int, seed int, segment int, segments int, prints binary"), buckets


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's classes with `maybe`: whether a filter says that the snapshot may hold them.
    However large a batch is, a task gets a share of a bucket's classes and the bucket's filter."""
    shares = max(1, -(-batch.count() // (buckets * KEYS_PER_PROBE)))

    def ask(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(rows), dtype=bool)
        if len(own) and len(rows):
            f = own.iloc[0]
            hit = probe_filter(_keys(rows["sha"]), int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["prints"], np.uint8))
        return pd.DataFrame({"sha": rows["sha"], "maybe": hit})

    share = F.pmod(F.xxhash64("sha"), F.lit(shares)).alias("share")
    left = batch.select("sha", _bucket(buckets).alias("bucket"), share).groupBy("bucket", "share")
    right = filters.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))).groupBy("bucket", "share")
    return left.cogroup(right).applyInPandas(ask, "sha string, maybe boolean")


def bounded(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def same_bytes(docs: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """Of pairs (sha, snap_id, batch_id), the sha whose two texts are equal byte by byte."""
    ids = pairs.select("sha", F.explode(F.array("snap_id", "batch_id")).alias("doc_id")).distinct()
    ids = F.broadcast(ids) if 2 * n_pairs <= BROADCAST_ROWS else ids
    texts = docs.select("doc_id", normalized(F.col("text")).alias("norm")).join(ids, "doc_id")
    texts = texts.where(F.sha2(F.col("norm").cast("binary"), 256) == F.col("sha"))
    return texts.groupBy("sha").agg((F.min("norm") == F.max("norm")).alias("same"))


def exact_groups(snapshot_docs: DataFrame, batch_docs: DataFrame, scratch: Scratch) -> DataFrame:
    """All rows of both inputs: doc_id, keep_id, group_size, kept, text_sha256.

    snapshot_docs are the immutable known texts, batch_docs the incoming ones. Digest
    rows are small; texts are read again only for the representatives of positives.
    """
    rows = scratch.save(
        digests(snapshot_docs).withColumn("side", F.lit(0)).unionByName(digests(batch_docs).withColumn("side", F.lit(1))), "digests"
    )
    snap = scratch.save(classes(rows.where("side = 0")), "snapshot")
    batch = scratch.save(classes(rows.where("side = 1")), "batch")
    filters, buckets = build_filters(snap, KEYS_PER_FILTER)
    filters = scratch.save(filters, "filters")
    asked = scratch.save(screen(batch, filters, buckets), "asked")
    # Only positives meet the snapshot.
    positive = batch.join(bounded(asked.where("maybe").select("sha")), "sha", "left_semi")
    old = snap.select("sha", F.col("n").alias("snap_n"), F.col("best").alias("snap_best"))
    pairs = scratch.save(old.join(bounded(scratch.save(positive, "positive")), "sha"), "pairs")
    ids = pairs.select("sha", F.col("snap_best.doc_id").alias("snap_id"), F.col("best.doc_id").alias("batch_id"))
    equal = same_bytes(snapshot_docs.select("doc_id", "text").unionByName(batch_docs.select("doc_id", "text")), ids, pairs.count())
    # With a null doc_id the texts cannot be fetched, and the digest decides.
    pairs = pairs.join(equal.where(~F.col("same")).select("sha"), "sha", "left_anti")
    merged = scratch.save(pairs.select("sha", (F.col("n") + F.col("snap_n")).alias("both"), F.least("best", "snap_best").alias("first")), "merged")
    group_size, keep_id = F.coalesce("both", "n").alias("group_size"), F.coalesce("first", "best").getField("doc_id").alias("keep_id")
    new = scratch.save(batch.join(bounded(merged), "sha", "left").select("sha", group_size, keep_id), "batch-groups")
    known = scratch.save(snap.join(bounded(merged), "sha", "left").select("sha", group_size, keep_id), "snapshot-groups")
    found = rows.where("side = 0").join(known, "sha").unionByName(rows.where("side = 1").join(new, "sha"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups of equal texts within one table: one half by a hash of doc_id is the
    snapshot, the other arrives as a batch, so every row passes the filters' path."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    half = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(2))
    return exact_groups(docs.where(half == 0), docs.where(half == 1), scratch)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, one per document."""
    scratch = Scratch(docs.sparkSession, "kept")
    found = scratch.save(exact_dedup(docs).select("doc_id", "kept", "group_size", "text_sha256"), "groups")
    gone = scratch.save(found.where("not kept").select("doc_id", "text_sha256").distinct(), "gone")
    n_gone = gone.count()
    repeated = not found.where("group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty()
    gone = F.broadcast(gone.select(F.col("doc_id").alias("__gone"), "text_sha256")) if n_gone <= BROADCAST_ROWS else gone.select(F.col("doc_id").alias("__gone"), "text_sha256")
    sha = F.sha2(normalized(docs["text"]).cast("binary"), 256)
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & (sha == gone["text_sha256"]), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
FROM n WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id)
"""
