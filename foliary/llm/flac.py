"""Media columns: FLAC streams in binary columns, written and read without audio libraries.

Decoding takes all frames of an Arrow batch together: one numpy step reads the k-th Rice
code of every frame, so the interpreter's work follows the block size and not the data.
Linear predictors (fixed ones by running sums, others by the recurrence, again all frames
at once) then give the samples. Header checksums, frame checksums and the stream's digest
are verified; a stream that fails raises. Streams are mono, 8 bits a sample; a seek table
names every frame's first sample and byte, and so do the PCM blocks that come out.

Edge cases: null and empty texts are 64 zero bytes; equal texts give equal streams; each
row is handled by itself, so null and repeated doc_ids stay as they are; other columns
are ignored; a null stream gives no PCM blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import tokens

BLOCK = 1024
RATE = 8000
UNIT = 64
#: Most bytes of payload that are encoded or decoded together.
TOGETHER = 3 << 19


def _table(poly: int, bits: int, inputs: int) -> np.ndarray:
    """Checksums of all inputs of that many bits, as if shifted in at the top."""
    crc = np.arange(1 << inputs, dtype=np.int64) << (bits - min(bits, inputs))
    for _ in range(inputs):
        crc = np.where(crc >> (bits - 1) & 1, (crc << 1) ^ poly, crc << 1) & ((1 << bits) - 1)
    return crc


CRC8 = _table(0x07, 8, 8).tolist()
CRC16_BYTE = _table(0x8005, 16, 8)
CRC16_PAIR = _table(0x8005, 16, 16)


def crc8(raw: bytes) -> int:
    crc = 0
    for b in raw:
        crc = CRC8[crc ^ b]
    return crc


def crc16(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of many byte ranges at once, two bytes a step."""
    order = np.argsort(-size, kind="stable")
    at, pairs = start[order], size[order] // 2
    crc = np.zeros(len(size), dtype=np.int64)
    for k in range(int(pairs.max(initial=0))):
        n = int(np.searchsorted(-pairs, -k, side="left"))
        p = at[:n] + 2 * k
        crc[:n] = CRC16_PAIR[crc[:n] ^ ((raw[p].astype(np.int64) << 8) | raw[p + 1])]
    odd = size[order] % 2 == 1
    last = raw[at[odd] + 2 * pairs[odd]].astype(np.int64)
    crc[odd] = CRC16_BYTE[(crc[odd] >> 8) ^ last] ^ (crc[odd] << 8 & 0xFFFF)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def number(n: int) -> bytes:
    """A frame number, coded like a long UTF-8 character."""
    if n < 128:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(~(2 * room + 1) & 0xFF) | n, *reversed(tail)])


@lru_cache(maxsize=1 << 16)
def header(frame: int, samples: int) -> bytes:
    own = b"\xff\xf8\x70\x02" + number(frame) + struct.pack(">H", samples - 1)  # block size in 16 bits, mono, 8 bits
    return own + bytes([crc8(own)])


# --- encoding -------------------------------------------------------------------


def place_bits(values: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes each value, right-aligned in its width, one after another: (bytes, ends in bits).
    Values have at most 32 significant bits."""
    ends = np.cumsum(widths)
    last = ends - 1
    word = last >> 5
    shifted = values.astype(np.uint64) << (31 - (last & 31)).astype(np.uint64)
    size = int(ends[-1] // 32) + 2
    # Fields do not overlap, so sums are unions; both halves are exact in doubles.
    sums = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    sums += np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), size)
    return np.frombuffer(sums.astype(np.uint64).astype(">u4").tobytes(), np.uint8)[4:], ends


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload: bytes as 8-bit samples around 128."""
    out: list[bytes] = []
    group: list[bytes] = []
    for k, p in enumerate(payloads):
        group.append(p)
        if k + 1 == len(payloads) or sum(map(len, group)) + len(payloads[k + 1]) > TOGETHER:
            out += _encode(group)
            group = []
    return out


def _encode(payloads: list[bytes]) -> list[bytes]:
    counts = np.array([-(-len(p) // BLOCK) for p in payloads])
    sizes = np.concatenate([[BLOCK] * (c - 1) + [len(p) - BLOCK * (c - 1)] for p, c in zip(payloads, counts.tolist(), strict=True)]).astype(np.int64)
    frames = len(sizes)
    inside = np.arange(BLOCK) < sizes[:, None]
    x = np.zeros((frames, BLOCK), dtype=np.int32)
    x[inside] = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    # Fixed predictors: the order with the least sum of residuals, then the best Rice parameter.
    residuals, sums = [x], [np.abs(x).sum(axis=1, where=inside)]
    for order in range(1, 5):
        d = residuals[-1].copy()
        d[:, 1:] -= residuals[-1][:, :-1]
        residuals.append(d)
        sums.append(np.where(sizes > order + 1, np.abs(d[:, order:]).sum(axis=1, where=inside[:, order:]), np.iinfo(np.int64).max // 2))
    order = np.argmin(sums, axis=0)
    chosen = np.choose(order[:, None], residuals)
    coded = inside & (np.arange(BLOCK) >= order[:, None])
    zigzag = np.where(chosen < 0, -2 * chosen - 1, 2 * chosen)
    n_coded = sizes - order
    costs = np.stack([n_coded * (k + 1) + (zigzag >> k).sum(axis=1, where=coded) for k in range(12)])
    k = np.argmin(costs, axis=0)
    constant = (x == x[:, :1]).all(axis=1, where=inside)
    verbatim = ~constant & (costs.min(axis=0) + 10 + 8 * order >= 8 * sizes)
    rice = ~constant & ~verbatim
    # Each frame is a list of fields (value, width): header bytes, subframe head, samples, padding, checksum.
    heads = [header(f, n) for c, p in zip(counts.tolist(), payloads, strict=True) for f, n in enumerate([BLOCK] * (c - 1) + [len(p) - BLOCK * (c - 1)])]
    n_head = np.array(list(map(len, heads)))
    body = np.where(constant, 1, sizes)
    fields = n_head + 2 + body + 2  # two for the subframe's head, two for padding and checksum
    first = np.cumsum(fields) - fields
    values = np.zeros(int(fields.sum()), dtype=np.int64)
    widths = np.zeros(int(fields.sum()), dtype=np.int64)
    where = np.repeat(first, n_head) + np.arange(int(n_head.sum())) - np.repeat(np.cumsum(n_head) - n_head, n_head)
    values[where] = np.frombuffer(b"".join(heads), np.uint8)
    widths[where] = 8
    kind = first + n_head
    values[kind] = np.where(constant, 0, np.where(verbatim, 2, 16 + 2 * order))
    widths[kind] = 8
    # The residual's coding method and partition order are zero; then the Rice parameter. They
    # stand after the warm-up samples, so the field below is moved behind them.
    rows = np.repeat(np.arange(frames), body)
    col = np.arange(int(body.sum())) - np.repeat(np.cumsum(body) - body, body)
    warm = np.where(rice, order, 0)
    slot = np.repeat(kind + 1, body) + col + (rice[rows] & (col >= warm[rows]))
    raw = ~(rice[rows] & (col >= warm[rows]))
    own_k = k[rows]
    z = zigzag[rows, col]
    values[slot] = np.where(raw, x[rows, col] & 0xFF, (1 << own_k) | (z & ((1 << own_k) - 1)))
    widths[slot] = np.where(raw, 8, (z >> own_k) + 1 + own_k)
    at = (kind + 1 + warm)[rice]
    values[at] = k[rice]
    widths[at] = 10
    ends = np.cumsum(widths)
    begin = np.concatenate([[0], ends[first[1:] - 1]]) if frames > 1 else np.array([0])
    used = ends[first + fields - 1] - begin
    pad = first + fields - 2
    widths[pad] = -used % 8
    widths[pad + 1] = 16
    packed, ends = place_bits(values, widths)
    packed = packed.copy()
    stop = ends[first + fields - 1] // 8
    start = np.concatenate([[0], stop[:-1]])
    crc = crc16(packed, start, stop - start - 2)
    packed[stop - 2], packed[stop - 1] = crc >> 8, crc & 0xFF
    return _streams(payloads, counts, packed.tobytes(), start, stop, sizes)


def _streams(payloads: list[bytes], counts: np.ndarray, packed: bytes, start: np.ndarray, stop: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    out, f = [], 0
    for p, c in zip(payloads, counts.tolist(), strict=True):
        own = slice(f, f + c)
        lengths = stop[own] - start[own]
        samples = np.frombuffer(p, np.uint8) ^ 0x80
        info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths.min()).to_bytes(3) + int(lengths.max()).to_bytes(3)
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8) + hashlib.md5(samples.tobytes(), usedforsecurity=False).digest()
        points = np.zeros(c, dtype=[("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        points["sample"], points["byte"], points["n"] = np.arange(c) * BLOCK, start[own] - start[f], sizes[own]
        blocks = b"fLaC" + b"\x00" + (34).to_bytes(3) + info + b"\x83" + (18 * c).to_bytes(3) + points.tobytes()
        out.append(blocks + packed[start[f] : stop[f + c - 1]])
        f += c
    return out


# --- decoding -------------------------------------------------------------------


class Bits:
    """Reads at many bit positions at once."""

    def __init__(self, raw: bytes):
        self.bytes = np.frombuffer(raw + bytes(16), np.uint8)
        self.words = np.ndarray((len(self.bytes) - 7,), ">u8", self.bytes, strides=(1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each position on, at the top of a word."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """n bits (at most 32) from each position on."""
        n = np.broadcast_to(np.asarray(n, dtype=np.uint64), at.shape)
        return np.where(n > 0, self.window(at) >> (np.uint64(64) - np.maximum(n, 1)), 0).astype(np.int64)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """How many zero bits stand before the next one bit."""
        total = np.zeros(len(at), dtype=np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            top = (self.window(at[open_] + total[open_]) >> np.uint64(11)).astype(np.float64)
            lead = 53 - np.frexp(top)[1]
            total[open_] += np.where(top > 0, lead, 53)
            open_ = open_[top == 0]
            if len(open_) and (at[open_] + total[open_] > 8 * len(self.bytes)).any():
                raise ValueError("a Rice code runs past the stream")
        return total


def signed(v: np.ndarray, bits: int) -> np.ndarray:
    return v - ((v >> (bits - 1)) << bits)


def read_number(raw: bytes, at: int) -> tuple[int, int]:
    """(frame or sample number, next place)."""
    b = raw[at]
    if b < 0x80:
        return b, at + 1
    extra = 8 - (b ^ 0xFF).bit_length() - 1
    n = b & (0x3F >> extra)
    for j in range(extra):
        n = n << 6 | raw[at + 1 + j] & 0x3F
    return n, at + 1 + extra


def frame_header(raw: bytes, at: int) -> tuple[int, int]:
    """(samples, place of the subframe), after its checksum is verified. Mono of 8 bits only."""
    if raw[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise ValueError("no frame here")
    code, rate = raw[at + 2] >> 4, raw[at + 2] & 15
    if raw[at + 3] >> 4 or raw[at + 3] >> 1 & 7 not in (0, 1):
        raise ValueError("only mono of 8 bits")
    _, p = read_number(raw, at + 4)
    if code in (6, 7):
        width = code - 5
        samples = int.from_bytes(raw[p : p + width]) + 1
        p += width
    else:
        samples = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(raw[at:p]) != raw[p]:
        raise ValueError("a frame header's checksum differs")
    return samples, p + 1


def decode_frames(bits: Bits, raw: bytes, starts: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of the frames that begin at these bytes, and where each ends."""
    heads = [frame_header(raw, s) for s in starts]
    order_by = sorted(range(len(heads)), key=lambda f: -heads[f][0])
    n = np.array([heads[f][0] for f in order_by])
    at = np.array([heads[f][1] for f in order_by], dtype=np.int64) * 8
    kind = bits.take(at, 8) >> 1
    if (bits.take(at, 8) & 1).any():
        raise ValueError("wasted bits are not supported")
    at += 8
    lpc = kind >= 32
    fixed = (kind >= 8) & (kind <= 12)
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, np.where(kind == 1, n, np.where(kind == 0, 1, 0))))
    if not (lpc | fixed | (kind <= 1)).all():
        raise ValueError("unknown subframe")
    most = int(n.max())
    x = np.zeros((len(n), most), dtype=np.int64)
    for j in range(int(order.max(initial=0))):  # raw samples
        has = np.flatnonzero(order > j)
        x[has, j] = signed(bits.take(at[has], 8), 8)
        at[has] += 8
    x[kind == 0] = x[kind == 0, :1]
    precision, shift = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    weights = np.zeros((len(n), 32), dtype=np.int64)
    if lpc.any():
        f = np.flatnonzero(lpc)
        precision[f], shift[f] = bits.take(at[f], 4) + 1, signed(bits.take(at[f] + 4, 5), 5)
        at[f] += 9
        for j in range(int(order[f].max())):
            has = f[order[f] > j]
            v = bits.take(at[has], precision[has])
            weights[has, j] = v - ((v >> (precision[has] - 1)) << precision[has])
            at[has] += precision[has]
    _residuals(bits, x, at, n, order, np.flatnonzero(lpc | fixed))
    for o in range(1, 5):  # a fixed predictor of order o undoes o differences
        f = np.flatnonzero(fixed & (order == o))
        y = x[f].copy()
        head = y[:, :o].copy()
        for _ in range(o):
            head[:, 1:] -= head[:, :-1].copy()
        y[:, :o] = head
        for _ in range(o):
            np.cumsum(y, axis=1, out=y)
        x[f] = y
    if lpc.any():
        f = np.flatnonzero(lpc)
        for i in range(1, most):
            go = f[(order[f] <= i) & (n[f] > i)]
            past = x[go][:, max(0, i - 32) : i][:, ::-1]
            x[go, i] += (past * weights[go, : past.shape[1]]).sum(axis=1) >> shift[go]
    stop = (at + 7) // 8
    begin = np.array([starts[f] for f in order_by])
    crc = crc16(bits.bytes, begin, stop - begin)
    if (crc != bits.take(stop * 8, 16)).any():
        raise ValueError("a frame's checksum differs")
    samples: list[np.ndarray] = [x[0]] * len(n)
    ends = np.zeros(len(n), dtype=np.int64)
    for row, f in enumerate(order_by):
        samples[f], ends[f] = x[row, : n[row]], stop[row] + 2
    return samples, ends


def _residuals(bits: Bits, x: np.ndarray, at: np.ndarray, n: np.ndarray, order: np.ndarray, rows: np.ndarray) -> None:
    """Rice codes of these rows into x, moving `at`; rows are in falling order of n."""
    if not len(rows):
        return
    method, parts = bits.take(at[rows], 2), bits.take(at[rows] + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    at[rows] += 6
    p, size, first = at[rows].copy(), n[rows], order[rows]
    run = size >> parts
    wide = np.where(method == 0, 4, 5)
    k = np.zeros(len(rows), dtype=np.int64)
    escaped = np.zeros(len(rows), dtype=bool)
    several = bool((parts > 0).any())
    steady = int(first.max())
    for i in range(int(first.min()), int(size.max())):
        live = int(np.searchsorted(-size, -i, side="left"))  # rows with more than i samples
        go: np.ndarray | slice = slice(0, live)
        if i < steady:
            go = np.flatnonzero(first[:live] <= i)
        if i <= steady or several:
            own = np.arange(live) if isinstance(go, slice) else go
            new = own[(i == first[own]) | (i % np.maximum(run[own], 1) == 0)] if several else own[i == first[own]]
            if len(new):
                k[new] = bits.take(p[new], wide[new])
                p[new] += wide[new]
                escaped[new] = k[new] == (1 << wide[new]) - 1
                e = new[escaped[new]]
                k[e] = bits.take(p[e], 5)
                p[e] += 5
        here, width = p[go], k[go]
        zeros = bits.zeros(here)
        low = bits.take(here + zeros + 1, width)
        z = zeros << width | low
        value = (z >> 1) ^ -(z & 1)
        step = zeros + 1 + width
        if escaped.any():
            e = escaped[go]
            plain = bits.take(here, width)
            value = np.where(e, plain - ((plain >> np.maximum(width - 1, 0)) << width), value)
            step = np.where(e, width, step)
        target = rows[go]
        x[target, i] = value
        p[go] = here + step
    at[rows] = p


def parse(raw: bytes) -> tuple[int, bytes, list[int], int]:
    """(samples, digest, seek points' bytes, place of the first frame)."""
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, samples, digest, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = bool(raw[at] >> 7), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4])
        body = raw[at + 4 : at + 4 + size]
        if kind == 0:
            samples, digest = int.from_bytes(body[10:18]) & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            table = np.frombuffer(body, [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
            points = table["byte"][table["sample"] < 2**64 - 1].astype(np.int64).tolist()
        at += 4 + size
    return samples, digest, points, at


def seek_samples(raw: bytes) -> np.ndarray:
    """The first samples of a stream's seek points."""
    at, last = 4, False
    while not last:
        last, kind, size = bool(raw[at] >> 7), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4])
        if kind == 3:
            table = np.frombuffer(raw[at + 4 : at + 4 + size], [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
            return table["sample"][table["sample"] < 2**64 - 1].astype(np.int64)
        at += 4 + size
    return np.zeros(0, dtype=np.int64)


def decode(streams: list[bytes]) -> list[list[np.ndarray]]:
    """The frames' samples of each stream. All frames that the seek tables name are decoded
    together; a stream without a full table is followed frame by frame."""
    out: list[list[np.ndarray]] = []
    group: list[bytes] = []
    for k, s in enumerate(streams):
        group.append(s)
        if k + 1 == len(streams) or sum(map(len, group)) + len(streams[k + 1]) > TOGETHER:
            out += _decode(group)
            group = []
    return out


def _decode(streams: list[bytes]) -> list[list[np.ndarray]]:
    raw = b"".join(streams)
    base = np.cumsum([0, *map(len, streams)]).tolist()
    bits, parsed = Bits(raw), [parse(s) for s in streams]
    starts = [b + p[3] + x for b, p in zip(base, parsed, strict=False) for x in p[2]]
    frames, ends = decode_frames(bits, raw, starts) if starts else ([], np.array([]))
    out, f = [], 0
    for b, stop, (samples, digest, points, head) in zip(base, base[1:], parsed, strict=False):
        own = frames[f : f + len(points)]
        at = int(ends[f + len(points) - 1]) if points else b + head
        f += len(points)
        while at < stop:
            more, end = decode_frames(bits, raw, [at])
            own = own + more
            at = int(end[0])
        if sum(map(len, own)) != samples and samples:
            raise ValueError("the number of samples differs")
        pcm = (np.concatenate(own) if own else np.array([])).astype(np.int8)
        if digest.strip(b"\0") and hashlib.md5(pcm.tobytes(), usedforsecurity=False).digest() != digest:
            raise ValueError("the samples' digest differs")
        out.append(own)
    return out


# --- columns --------------------------------------------------------------------


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (a FLAC stream of the padded text)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tokens.columns(batch, "text")[0]
            media = encode([payload(t) for t in texts])
            sizes = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


@dataclass
class Block:
    """The PCM of one frame and the number of its first sample, by which it can be found."""

    offset: int
    pcm: np.ndarray


def blocks_of(streams: list[bytes]) -> list[list[Block]]:
    """Every stream's samples as blocks with seekable offsets."""
    out = []
    for frames in decode(streams):
        offsets = np.cumsum([0, *map(len, frames)]).tolist()
        out.append([Block(o, x.astype(np.int8)) for o, x in zip(offsets, frames, strict=False)])
    return out


def seek(streams: list[bytes], offsets: list[int], count: int) -> list[np.ndarray]:
    """The `count` samples (fewer at the end) from an offset of each stream. Decoding begins at the last seek
    point before it, or at the first frame, and goes on frame by frame, all streams together."""
    parts, first = [], []
    for s, offset in zip(streams, offsets, strict=True):
        _, _, points, head = parse(s)
        samples = seek_samples(s)
        at = int(np.searchsorted(samples, offset, side="right")) - 1
        beyond = int(np.searchsorted(samples, offset + count, side="left"))
        parts.append(s[head + (points[at] if at >= 0 else 0) : head + points[beyond] if beyond < len(points) else len(s)])
        first.append(int(samples[at]) if at >= 0 else 0)
    raw = b"".join(parts)
    bits, stop = Bits(raw), np.cumsum(list(map(len, parts))).tolist()
    at, got = [e - len(p) for e, p in zip(stop, parts, strict=True)], [[] for _ in parts]
    todo = list(range(len(parts)))
    while todo:
        frames, ends = decode_frames(bits, raw, [at[k] for k in todo])
        for k, x, end in zip(todo, frames, ends.tolist(), strict=True):
            got[k].append(x)
            at[k] = end
        todo = [k for k in todo if sum(map(len, got[k])) < offsets[k] - first[k] + count and at[k] < stop[k]]
    return [np.concatenate(x)[o - f : o - f + count].astype(np.int8) for x, o, f in zip(got, offsets, first, strict=True)]


def read_samples(media: DataFrame, count: int = UNIT) -> DataFrame:
    """doc_id, sample_offset, pcm of media (doc_id, media, sample_offset): random reads of stored streams."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, streams, offsets = tokens.columns(batch, "doc_id", "media", "sample_offset")
            some = [k for k, (s, o) in enumerate(zip(streams, offsets, strict=True)) if s is not None and o is not None]
            found = dict(zip(some, seek([streams[k] for k in some], [offsets[k] for k in some], count) if some else [], strict=True))
            pcm = [found[k].tobytes() if k in found else None for k in range(len(doc_ids))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample_offset"), pa.array(pcm, pa.binary())], names=["doc_id", "sample_offset", "pcm"])

    rows = media.select(F.col("doc_id").cast("long"), "media", F.col("sample_offset").cast("long"))
    return rows.mapInArrow(read, "doc_id long, sample_offset long, pcm binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample_offset, n_samples, pcm (signed bytes) of every frame of every stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, streams = tokens.columns(batch, "doc_id", "media")
            some = [(d, s) for d, s in zip(doc_ids, streams, strict=True) if s is not None]
            rows = [(doc_id, k, x.offset, len(x.pcm), x.pcm.tobytes()) for (doc_id, _), own in zip(some, blocks_of([s for _, s in some]), strict=True) for k, x in enumerate(own)]
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(read, "doc_id long, block int, sample_offset long, n_samples int, pcm binary")


def middle(samples: int) -> int:
    """Where a stream is read at random: UNIT samples from the middle on, never beyond the end."""
    return min(samples // 2, samples - UNIT)


def describe(blocks: list[Block], sought: np.ndarray) -> str:
    """Features of a stream's PCM blocks: their number, the loudest one's first sample, sums over all; and the
    checksum of what a random read of the stream gives."""
    x = np.concatenate([b.pcm for b in blocks]).astype(np.int64)
    energy = [int((b.pcm.astype(np.int64) ** 2).sum()) for b in blocks]
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    loudest = blocks[int(np.argmax(energy))].offset
    return f"blocks={len(blocks)};sum={int(x.sum())};energy={sum(energy)};peak={int(np.abs(x).max())};turns={turns};loudest={loudest};middle={zlib.crc32(sought.tobytes()):08x}"


def digest(media: DataFrame) -> DataFrame:
    """Checksums and features of the PCM blocks that the stored streams hold, and of a random read of each."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, sizes, streams = tokens.columns(batch, "doc_id", "n_bytes", "media")
            if not doc_ids:
                continue
            rows, found = [], blocks_of(streams)
            sought = seek(streams, [middle(own[-1].offset + len(own[-1].pcm)) for own in found], UNIT)
            for doc_id, size, stream, own, part in zip(doc_ids, sizes, streams, found, sought, strict=True):
                raw = (np.concatenate([b.pcm for b in own]).view(np.uint8) ^ 0x80).tobytes()
                rows.append((doc_id, size, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), describe(own, part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(read, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text as a FLAC stream in a column, reads the column's bytes back, and describes them."""
    return digest(store(docs))
