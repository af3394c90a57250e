"""FLAC round trips, checksums, and what the encoder doesn't write itself."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from foliary.llm import flac


def join(frames):
    return (np.concatenate(frames).astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


def texts():
    r = random.Random(5)
    return ["", None, "a", "hello world " * 300, "x" * 5000, "é" * 1000, *("".join(r.choice("ab cdé\n") for _ in range(r.randint(0, 6000))) for _ in range(30))]


def test_round_trip():
    payloads = [flac.payload(t) for t in texts()] + [random.Random(1).randbytes(3000), bytes(3072), random.Random(2).randbytes(1)]
    streams = flac.encode(payloads)
    assert [join(d) for d in flac.decode(streams)] == payloads
    assert [join(flac.decode([s])[0]) for s in streams] == payloads
    assert len(flac.encode([b"ab" * 8000])[0]) < 8000


def test_streams_without_a_seek_table():
    payload = random.Random(3).randbytes(500) * 7
    stream = flac.encode([payload])[0]
    head = stream[:4] + b"\x80" + stream[5:42]  # STREAMINFO is the last block now
    size = int.from_bytes(stream[43:46])
    assert join(flac.decode([head + stream[46 + size :]])[0]) == payload


@pytest.mark.parametrize("where", ["header", "body", "digest"])
def test_damage_is_found(where):
    stream = bytearray(flac.encode([b"some text that repeats " * 200])[0])
    _, _, points, first = flac.parse(bytes(stream))
    stream[{"header": first + 4, "body": first + 300, "digest": 30}[where]] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, value, k):
        z = 2 * value if value >= 0 else -2 * value - 1
        self.bits += "0" * (z >> k) + "1"
        self.put(z, k)

    def bytes(self):
        return int((self.bits + "0" * (-len(self.bits) % 8)) or "0", 2).to_bytes(-(-len(self.bits) // 8))


def frame(samples, subframe):
    w = Writer()
    subframe(w)
    raw = flac.header(0, len(samples)) + w.bytes()
    crc = 0
    for b in raw:
        crc ^= b << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    info = struct.pack(">HH", 1024, 1024) + bytes(6) + ((8000 << 44) | (7 << 36) | len(samples)).to_bytes(8)
    info += hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    return b"fLaC\x80" + (34).to_bytes(3) + info + raw + struct.pack(">H", crc)


@pytest.mark.parametrize("method", [0, 1])
def test_linear_predictor_with_partitions_and_escapes(method):
    x = [int(90 * np.sin(k / 9)) for k in range(256)]
    weights, shift = [15, -7], 3

    def write(w):
        w.put(0, 1), w.put(32 + 1, 6), w.put(0, 1)
        for v in x[:2]:
            w.put(v, 8)
        w.put(6 - 1, 4), w.put(shift, 5)
        for c in weights:
            w.put(c, 6)
        w.put(method, 2), w.put(2, 4)
        rest = [x[i] - ((weights[0] * x[i - 1] + weights[1] * x[i - 2]) >> shift) for i in range(2, 256)]
        for part in range(4):
            own = rest[max(0, 64 * part - 2) : 64 * part + 62]
            if part == 2:
                w.put((1 << (4 + method)) - 1, 4 + method), w.put(9, 5)
                for v in own:
                    w.put(v, 9)
            else:
                w.put(part + 1, 4 + method)
                for v in own:
                    w.rice(v, part + 1)

    assert np.concatenate(flac.decode([frame(x, write)])[0]).tolist() == x


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_features(name, request):
    df = request.getfixturevalue(name)
    got = sorted(flac.media_features(df).collect(), key=str)
    want = []
    for r in df.collect():
        p = flac.payload(r.text)
        want.append((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert len(p) % 64 == 0 and p
    assert [tuple(r)[:5] for r in got] == sorted(want, key=lambda w: str(next(g for g in got if tuple(g)[:5] == w)))


def test_pcm_blocks(odd_docs):
    blocks = flac.pcm_blocks(flac.store(odd_docs.where("doc_id = 4"))).orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [1024 * b.block for b in blocks]
    raw = (np.frombuffer(b"".join(b.pcm for b in blocks), np.uint8) ^ 0x80).tobytes()
    assert raw == flac.payload(odd_docs.where("doc_id = 4").first().text)


def test_empty(no_docs):
    assert flac.media_features(no_docs).count() == 0


def test_checksums_of_many_ranges():
    raw = np.frombuffer(random.Random(9).randbytes(500), np.uint8)
    start, size = np.array([0, 10, 499, 5]), np.array([500, 31, 1, 0])
    want = []
    for a, n in zip(start, size, strict=True):
        crc = 0
        for b in raw[a : a + n].tolist():
            crc ^= b << 8
            for _ in range(8):
                crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        want.append(crc)
    assert flac.crc16(raw, start, size).tolist() == want
