"""Documents and tokens of flat token files, found by scanning for the end id.

A shard is a stream of fixed-width ids, cut into blocks of equal length wherever they
fall; nothing in it tells where a document is. Each block is searched on its own by one
vector comparison. A prefix scan over a shard's blocks then carries the ids, documents
and the unfinished document across block boundaries.

Beside the stream, a shard keeps a list of the doc_ids it was written from, used only to
name the documents that the scan has found.

Edge cases: null and empty texts are documents of one id (the end id); ids after a
shard's last end id are an unfinished document, returned with complete = false and a
null doc_id; an empty table has no shards and no rows; null and repeated doc_ids are
carried as they are; other columns are ignored. The end id's string in a text is encoded as
ordinary text, unlike by the library's default, so that it ends no document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm import tokens
from foliary.llm.scratch import Scratch

BLOCK_IDS = 1 << 17
#: doc_ids in one row of a shard's list.
LIST_ROWS = 1 << 14
FLAT = "shard int, block int, payload binary, doc_ids array<long>"
END = "<|endoftext|>"


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_flat(docs: DataFrame, scratch: Scratch, tokenizer: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes every text and writes its shards' streams; returns the table as read back.
    Shards follow the input's partitions, so no text is shuffled."""
    end, dtype = tokens.token_id(tokenizer, END), width(tokens.vocabulary_size(tokenizer))

    def row(shard: int, block: int, payload: bytes | None, doc_ids: list | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([payload], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64()))], names=["shard", "block", "payload", "doc_ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, part = TaskContext.get().partitionId(), 0, 0
        rest = np.array([], dtype=dtype)
        names: list[int | None] = []
        for batch in batches:
            doc_ids, texts = tokens.columns(batch, "doc_id", "text")
            names += doc_ids
            rest = np.concatenate([rest, *(x.astype(dtype) for x in tokens.encode(texts, tokenizer, end, ordinary=True))])
            while len(rest) >= block_ids:
                yield row(shard, block, rest[:block_ids].tobytes(), None)
                block, rest = block + 1, rest[block_ids:]
            while len(names) >= LIST_ROWS:
                yield row(shard, part, None, names[:LIST_ROWS])
                part, names = part + 1, names[LIST_ROWS:]
        if len(rest):
            yield row(shard, block, rest.tobytes(), None)
        if names:
            yield row(shard, part, None, names)

    return scratch.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, FLAT), "flat")


def separators(streams: DataFrame, end: int, dtype: str) -> DataFrame:
    """Of each block: its number of ids and the places of the end id in it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, block, payload = batch.column("shard"), batch.column("block"), tokens.columns(batch, "payload")[0]
            ids = [np.frombuffer(x, dtype) for x in payload]
            ends = pa.array([np.flatnonzero(x == end) for x in ids], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([shard, block, pa.array(list(map(len, ids)), pa.int64()), ends], names=["shard", "block", "n_ids", "ends"])

    return streams.select("shard", "block", "payload").mapInArrow(find, "shard int, block int, n_ids long, ends array<long>")


def scan(blocks: DataFrame) -> DataFrame:
    """From separators(): shard, ordinal (of the document in its shard), start (ids before it
    in the shard), n_tokens (with the end id), complete."""
    order = Window.partitionBy("shard").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    # Where the document begins that is open at the block's start.
    last_end = F.when(F.size("ends") > 0, F.col("ids_before") + F.element_at("ends", -1) + 1)
    placed = placed.withColumn("open", F.coalesce(F.max(last_end).over(before), F.lit(0)))
    stop = F.col("ids_before") + F.col("end") + 1
    start = F.when(F.col("pos") == 0, F.col("open")).otherwise(F.col("ids_before") + F.get("ends", F.col("pos") - 1) + 1)
    done = placed.select("*", F.posexplode("ends").alias("pos", "end")).select(
        "shard", (F.col("docs_before") + F.col("pos")).cast("long").alias("ordinal"), start.cast("long").alias("start"), (stop - start).cast("long").alias("n_tokens"), F.lit(True).alias("complete")
    )
    sums = placed.groupBy("shard").agg(F.sum("n_ids").alias("ids"), F.sum(F.size("ends")).alias("docs"), F.coalesce(F.max(last_end), F.lit(0)).alias("open"))
    cut = sums.where("ids > open").select("shard", F.col("docs").cast("long").alias("ordinal"), F.col("open").cast("long").alias("start"), (F.col("ids") - F.col("open")).cast("long").alias("n_tokens"), F.lit(False).alias("complete"))
    return done.unionByName(cut)


def count_tokens(flat: DataFrame, end: int, dtype: str, scratch: Scratch) -> DataFrame:
    """doc_id, shard, ordinal, start, n_tokens, complete of every document in the flat files."""
    blocks = scratch.save(separators(flat.where("payload IS NOT NULL"), end, dtype), "separators")
    lists = flat.where("doc_ids IS NOT NULL").select("shard", "block", F.posexplode("doc_ids").alias("pos", "doc_id"))
    named = lists.select("shard", (F.col("block").cast("long") * LIST_ROWS + F.col("pos")).alias("ordinal"), "doc_id")
    return scan(blocks).join(named, ["shard", "ordinal"], "left").select("doc_id", "shard", "ordinal", "start", "n_tokens", "complete")


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes flat token files of all documents and counts them again by scanning."""
    path, scratch = tokenizer or tokens.default_path(), Scratch(docs.sparkSession, "token-count")
    flat = write_flat(docs, scratch, path)
    return count_tokens(flat, tokens.token_id(path, END), width(tokens.vocabulary_size(path)), scratch)
