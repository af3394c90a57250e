"""Token ids at fixed width: each id takes the fewest bits that hold the vocabulary.

A shard is a Parquet file of blocks in ascending doc_id order. A block holds whole
documents (one that is longer than a block has its own): the packed bits, the doc_ids,
where each document starts in the block, and the ids of the shard before the block.
Any id is found by arithmetic, so one document is read without unpacking its block.

Edge cases: null and empty texts have the end id only; null doc_ids come first; rows
that repeat a doc_id follow one another, ordered by text; other columns are ignored;
an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm import tokens
from foliary.llm.scratch import Scratch

BLOCK_IDS = 1 << 16
#: Ids that are packed at once; a multiple of 8.
SLICE = 1 << 15
#: Shards whose offsets (16 bytes each) may be broadcast; beyond it the join shuffles.
BROADCAST_SHARDS = 100_000
BLOCKS = "shard int, block int, bits int, shard_start long, n_ids long, doc_ids array<long>, doc_starts array<long>, payload binary"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bits, the first id lowest."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shifts = np.arange(bits, dtype=np.uint32)
    # Slices of whole bytes, as the matrix of bits takes far more room than ids do.
    slices = (ids[k : k + SLICE].astype(np.uint32)[:, None] >> shifts & 1 for k in range(0, len(ids), SLICE))
    return b"".join(np.packbits(x.astype(np.uint8), bitorder="little").tobytes() for x in slices)


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """The ids start .. start + count, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(payload[first : (start + count) * bits // 8 + 1] + bytes(5), np.uint8).astype(np.uint64)
    at = np.arange(start, start + count, dtype=np.uint64) * np.uint64(bits) - np.uint64(first * 8)
    byte = (at >> np.uint64(3)).astype(np.int64)
    word = sum(raw[byte + j] << np.uint64(8 * j) for j in range(5))
    return ((word >> (at & np.uint64(7))) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_blocks(docs: DataFrame, scratch: Scratch, tokenizer: str, end: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes every text and writes the blocks; returns the table as read back."""
    bits = bits_for(tokens.vocabulary_size(tokenizer))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, held)])
            row = [shard, block, bits, start, size, names, starts[:-1].tolist(), pack(np.concatenate(held), bits)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TYPES, strict=True)], names=NAMES)

        for batch in batches:
            doc_ids, texts = tokens.columns(batch, "doc_id", "text")
            for doc_id, ids in zip(doc_ids, tokens.encode(texts, tokenizer, end), strict=True):
                if held and size + len(ids) > block_ids:
                    yield flush()
                    block, start, size, held, names = block + 1, start + size, 0, [], []
                held.append(ids)
                names.append(doc_id)
                size += len(ids)
        if held:
            yield flush()

    # The text's hash comes in as rows of one doc_id, or of none, may be many: they are split like any others.
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    return scratch.save(ordered.mapInArrow(blocks, BLOCKS), "blocks")


LONGS = pa.list_(pa.int64())
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), LONGS, LONGS, pa.binary()]


def documents(blocks: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # One row per shard; shards are ranges of doc_id, in order.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.cast("long").alias("before"))
    shards = F.broadcast(shards) if shards.count() <= BROADCAST_SHARDS else shards

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                ends = [*row["doc_starts"][1:], row["n_ids"]]
                for doc_id, start, stop in zip(row["doc_ids"], row["doc_starts"], ends, strict=True):
                    ids = unpack(row["payload"], row["bits"], start, stop - start)
                    out.append((doc_id, row["before"] + row["shard_start"] + start, stop - start, zlib.crc32(ids.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(shards, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the ids of all documents bit-packed and reads them back."""
    scratch = Scratch(docs.sparkSession, "bitpack")
    return documents(write_blocks(docs, scratch, tokenizer or tokens.default_path()))
