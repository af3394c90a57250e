"""Stored, counted and packed token ids against the tokenizers library on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from foliary.llm import bitpack, packing, token_count, tokens
from foliary.llm.scratch import Scratch

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def library():
    """The library as it is."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ordinary():
    """With special tokens' strings as ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_chunks_equal_whole_texts(library, ordinary):
    r = random.Random(3)
    letters = " \n\t.ab'é1!|sS　日"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    texts += ["<|endoftext|> x", "a <|endoftext|>", "a <|endoftext|> b", "<|endoftext|>" * 3, "<|endoftext| >", "don't  we'll", " lead", "trail ", "a\x1cb \x1c c", "é x"]
    for want, flag in ((library, False), (ordinary, True)):
        for text, ids in zip(texts, tokens.encode(texts, PATH, None, flag), strict=True):
            assert ids.tolist() == want(text), ascii(text)
    assert 50256 in library("a <|endoftext|> b") and 50256 not in ordinary("a <|endoftext|> b")


def test_chunk_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    chunks = tokens.Chunks(PATH)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    assert np.frombuffer(chunks.text(text), chunks.dtype).tolist() == library(text)
    assert len(chunks) <= 50


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    packed = bitpack.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    for start, count in [(0, 1000), (0, 0), (999, 1), (13, 500)]:
        assert (bitpack.unpack(packed, bits, start, count) == ids[start : start + count]).all()


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_token_ids(name, request, library):
    df = request.getfixturevalue(name)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "", r.doc_id) for r in df.collect()))
    start, want = 0, []
    for *_, text, doc_id in rows:
        ids = [*library(text), 0]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = [tuple(r) for r in bitpack.token_ids(df).orderBy("start").collect()]
    assert got == want


def test_token_ids_small_blocks(docs, library, spark):
    blocks = bitpack.write_blocks(docs, Scratch(spark, "t"), PATH, block_ids=500)
    got = {r.doc_id: r.ids_crc32 for r in bitpack.documents(blocks).collect()}
    assert got == {r.doc_id: crc([*library(r.text), 0]) for r in docs.collect()}


@pytest.mark.parametrize("block_ids", [7, 1000, 1 << 17])
@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_token_counts(name, block_ids, request, ordinary, spark):
    df = request.getfixturevalue(name)
    if block_ids == 7:
        df = df.where("length(text) < 3000 OR text IS NULL")
    scratch = Scratch(spark, "t")
    flat = token_count.write_flat(df, scratch, PATH, block_ids)
    got = token_count.count_tokens(flat, 50256, "<u2", scratch).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.n_tokens) for r in got], key=key) == sorted([(r.doc_id, len(ordinary(r.text)) + 1) for r in df.collect()], key=key)
    assert all(r.complete for r in got)
    for shard in {r.shard for r in got}:
        own = sorted((r.ordinal, r.start, r.n_tokens) for r in got if r.shard == shard)
        assert [o for o, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == np.cumsum([0, *(n for _, _, n in own)])[:-1].tolist()


def test_unfinished_document(spark):
    rows = [(0, 0, np.array([5, 9, 9], "<u2").tobytes()), (0, 1, np.array([9, 5, 5], "<u2").tobytes()), (0, 2, np.array([9, 9], "<u2").tobytes())]
    df = spark.createDataFrame(rows, "shard int, block int, payload binary")
    got = token_count.scan(token_count.separators(df, 5, "<u2")).orderBy("start").collect()
    assert [(r.ordinal, r.start, r.n_tokens, r.complete) for r in got] == [(0, 0, 1, True), (1, 1, 4, True), (2, 5, 1, True), (3, 6, 2, False)]


@pytest.mark.parametrize("weights, lanes", [(None, 10_000), ({"a": 1.0, "b": 3.0}, 10_000), ("uniform", 10_000), (None, 2), ("uniform", 2)])
@pytest.mark.parametrize("name", ["docs", "odd_docs"])
def test_packing(name, weights, lanes, request, library):
    df = request.getfixturevalue(name)
    if weights == "uniform":
        weights = {r.source or "": 1.0 for r in df.collect()}
    pieces = packing.pack(df, weights=weights, window=8192, max_lanes=lanes).collect()
    rows = df.collect()
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id, crc([*library(r.text), 0])] += 1
    ids_of = {r.doc_id: [*library(r.text), 0] for r in rows}
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc_id, own in by_doc.items():
        ids, times = ids_of[doc_id], sum(r.doc_id == doc_id for r in rows)
        assert sum(p.length for p in own) == len(ids) * times
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for p in own)
    assert set(by_doc) == set(ids_of)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, own in sequences.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 1024 or k == len(sequences) - 1


def test_lanes_mix_their_sources(spark):
    """With fewer lanes than sources every window still has all sources in proportion."""
    df = spark.range(1200).selectExpr("id AS doc_id", "repeat('a ', 40) AS text", "CASE WHEN id % 2 = 0 THEN 'big' ELSE concat('s', id % 6) END AS source").repartition(3)
    pieces = packing.pack(df, window=4096, max_lanes=2).collect()
    total, share = 0, {}
    for p in pieces:
        window = (p.sequence_id * 1024 + p.offset) // 4096
        total += p.length
        source = "big" if p.doc_id % 2 == 0 else f"s{p.doc_id % 6}"
        share[window, source] = share.get((window, source), 0) + p.length
    for window in range(total // 4096):
        assert abs(share[window, "big"] / 4096 - 0.5) < 0.05
        assert all(abs(share[window, f"s{k}"] / 4096 - 1 / 6) < 0.05 for k in (1, 3, 5))


def test_windows_hold_their_shares():
    rounds = packing.Rounds([100_000, 50_000, 7, 50_000], [2, 1, 1e-4, 1])
    n = np.arange(0, 200_008, 997)
    served = rounds.served(n)
    assert (served.sum(axis=1) == n).all() and (np.diff(served, axis=0) >= 0).all()
    assert (abs(served[:, 0] - n / 2) <= 8).all()


def test_empty_tables(no_docs):
    assert bitpack.token_ids(no_docs).count() == token_count.token_counts(no_docs).count() == packing.pack(no_docs).count() == 0
