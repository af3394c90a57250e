"""Many sources, very long texts, large banks, odd letters, random reads, clashing names, hot ids."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import bitpack, flac, langid, license_join, mixing, packing, quality_gam, scratch
from tests.llm.test_mixing_licenses import scan
from tests.llm.test_models import PATH


# --- packing with many sources --------------------------------------------------------


def many_sources(spark, docs, sources):
    """Half of the ids are of one source, the others of all the rest alike."""
    return spark.range(docs).selectExpr("id AS doc_id", "repeat('word and more ', 60) AS text", f"CASE WHEN id % 2 = 0 THEN 'big' ELSE concat('s', id % {sources}) END AS source").repartition(4)


def checked(pieces, docs):
    """Each id in one piece, every sequence full but the last; ids of each document."""
    sums = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.min("doc_tokens").alias("a"), F.max("doc_tokens").alias("b"), F.sum(F.col("start") + F.col("length")).alias("ends"), F.sum("start").alias("starts"))
    assert sums.count() == docs and sums.where("n <> a OR a <> b OR ends - starts <> n").isEmpty()
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    last = full.agg(F.max("sequence_id")).first()[0]
    assert full.where(f"n <> end OR (sequence_id < {last} AND n <> 1024)").isEmpty() and full.count() == last + 1


@pytest.mark.parametrize("sources", [100, 10_000])
def test_packing_of_many_sources(spark, sources):
    df = many_sources(spark, 10_000, sources)
    began = time.monotonic()
    pieces = scratch.Scratch(spark, "test").save(packing.pack(df), "pieces")
    assert time.monotonic() - began < 120  # 66 s for 200 documents when all totals were one table
    checked(pieces, 10_000)
    window = F.floor((F.col("sequence_id") * 1024 + F.col("offset")) / packing.WINDOW)
    shares = pieces.groupBy(window.alias("w")).agg((F.sum(F.when(F.col("doc_id") % 2 == 0, F.col("length")).otherwise(0)) / F.sum("length")).alias("big"), F.count("*").alias("n")).orderBy("w").collect()
    assert all(abs(r.big - 0.5) < 0.02 for r in shares[:-1])


def test_a_tree_of_lanes_holds_few_totals(spark):
    """100,000 sources: no node has more than a few times max_lanes children, and the root about max_lanes."""
    sources = spark.range(100_000).selectExpr("concat('s', id) AS source", "id % 7 + 1 AS n").withColumn("weight", F.col("n").cast("double"))
    depth, paths, levels = packing.tree(sources, 100_000, 64, scratch.Scratch(spark, "test"))
    assert depth == 3 and paths.count() == 100_000
    for k, level in enumerate(levels):
        most, total = level.agg(F.max(F.size(f"children{k}")), F.sum(F.expr(f"aggregate(children{k}, 0L, (a, c) -> a + c.n)"))).first()
        assert most <= 128 and total == sum(k % 7 + 1 for k in range(100_000))


def test_rounds_by_narrow_brackets_are_the_rounds():
    """Against one id at a time: always the queue whose next id is due first."""
    r = np.random.default_rng(4)
    for _ in range(20):
        totals, weights = r.integers(0, 30, 6) + 1, r.random(6) + 0.01
        rounds = packing.Rounds(totals.tolist(), weights.tolist())
        p, now, want = weights / weights.sum(), np.zeros(6, dtype=int), [np.zeros(6, dtype=int)]
        for _ in range(totals.sum()):
            due = np.where(now < totals, (now + 0.5) / p, np.inf)
            now[due.argmin()] += 1
            want.append(now.copy())
        assert (rounds.served(np.arange(totals.sum() + 1)) == np.array(want)).all()


# --- licenses in long texts and large banks ------------------------------------------------


def template_words(n, seed=0):
    r = random.Random(seed)
    vocabulary = sorted({w for _, t in license_join.TEMPLATES for w in t.split()})
    return " ".join(r.choice(vocabulary) if r.random() < 0.4 else f"w{r.randrange(5000)}" for _ in range(n))


def test_a_million_words_of_templates(spark):
    df = spark.createDataFrame([(1, template_words(1_000_000))], "doc_id long, text string")
    began = time.monotonic()
    assert license_join.scan_licenses(df).first().n_words == 1_000_000
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("part", [7, 50])
def test_texts_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(license_join, "PART", part)
    texts = [template_words(n, n) for n in (1, 6, 7, 8, 13, 14, 15, 300, 1500)] + [t for _, t in license_join.TEMPLATES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.8, 0.4):
        got = [tuple(r) for r in license_join.scan_licenses(df, threshold=threshold).orderBy("doc_id").collect()]
        assert got == [(k, *scan(t, license_join.TEMPLATES, threshold)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("set_words, rows", [(5_000, 20_000), (0, 0)])
def test_a_bank_of_500(spark, monkeypatch, set_words, rows):
    monkeypatch.setattr(license_join, "SET_WORDS", set_words)
    monkeypatch.setattr(license_join, "BROADCAST_ROWS", rows)
    r = random.Random(1)
    bank = [(f"t{k:03}", " ".join(f"v{r.randrange(20_000)}" for _ in range(r.randrange(3, 60)))) for k in range(500)] + [("none", " ")]
    texts = []
    for k in range(60):
        words = [f"v{r.randrange(20_000)}" for _ in range(80)] + [w for w in bank[k * 8][1].split() if r.random() < 0.9] + [f"v{r.randrange(20_000)}" for _ in range(80)]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(x) for x in license_join.scan_licenses(df, bank).orderBy("doc_id").collect()]
    assert got == [(k, *scan(t, bank[:500], 0.8)) for k, t in enumerate(texts)] and sum(x[6] != "" for x in got) > 20


# --- letters ----------------------------------------------------------------------------


def test_numerals_are_no_letters(spark):
    texts = ["½ ²", "Ⅷ", "②", "١٢ ³x", "x½y", "áb", "हिन्दी", "ก็ดี", "", None, "́", "𝐀𝐁 𝟙", "İstanbul", "日本 ①", "_ __", "ªº"]
    model = (["de", "en"], np.full((len(langid.vocabulary(PATH)) + 1, 2), -9.0), np.log([0.5, 0.5]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert {texts[k] for k, lang in got.items() if lang == "und"} == {"½ ²", "Ⅷ", "②", "", None, "́", "_ __"}
    assert langid.words_of("x½y Ⅷa") == ["x", "y", "a"] and langid.words_of("हिन्दी ก็ดี") == ["हिन्दी", "ก็ดี"] and langid.words_of("áb") == ["áb"]


def test_fast_patterns_are_the_slow_one():
    r = random.Random(2)
    pool = "abcXYZ äöüßéñ 0123 ½²Ⅷ② _-'’ ́̀ हिन्दी กี 日本語 𝐀𝟙  \u0085 İı ªº ʰ ǅ"
    for _ in range(5000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(12)))
        assert langid.words_of(text) == langid.WORD.findall(text.lower()), text


# --- random reads -----------------------------------------------------------------------


def test_random_reads_of_the_stored_column(spark, odd_docs):
    media = scratch.Scratch(spark, "test").save(flac.store(odd_docs), "media")
    payloads = {r.doc_id: flac.payload(r.text) for r in odd_docs.collect()}
    r = random.Random(3)
    for count in (1, 64, 3000):
        places = {d: r.randrange(len(p)) for d, p in payloads.items()} | {4: 1023, 5: len(payloads[5]) - 1}
        at = spark.createDataFrame(list(places.items()), "d long, sample_offset long")
        rows = flac.read_samples(media.join(at, media.doc_id.eqNullSafe(at.d)), count).collect()
        assert len(rows) == odd_docs.count()
        for row in rows:
            raw = bytes(b ^ 0x80 for b in row.pcm)
            assert raw == payloads[row.doc_id][row.sample_offset : row.sample_offset + count]


def test_reads_without_seek_points():
    raw = flac.payload("some text " * 900)
    stream = flac.encode([raw])[0]
    size = int.from_bytes(stream[43:46])
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[46 + size :]
    for s in (stream, bare):
        for at in (0, 5, 1020, 1024, 5000, len(raw) - 10):
            assert bytes(x ^ 0x80 for x in flac.seek([s], [at], 64)[0].tobytes()) == raw[at : at + 64]


def test_features_of_blocks(docs):
    got = {r.doc_id: r for r in flac.media_features(docs).collect()}
    stored = {r.doc_id: bytes(r.media) for r in flac.store(docs).collect()}
    for r in docs.collect():
        x = np.frombuffer(flac.payload(r.text), np.uint8).astype(int) - 128
        blocks = [x[k : k + 1024] for k in range(0, len(x), 1024)]
        loudest = 1024 * int(np.argmax([(b * b).sum() for b in blocks]))
        middle = min(len(x) // 2, len(x) - 64)
        crc = zlib.crc32(x[middle : middle + 64].astype(np.int8).tobytes())
        want = f"blocks={len(blocks)};sum={x.sum()};energy={(x * x).sum()};peak={abs(x).max()};turns={((x[1:] < 0) != (x[:-1] < 0)).sum()};loudest={loudest};middle={crc:08x}"
        own = got[r.doc_id]
        import hashlib

        assert own.feature == want and own.media_bytes == len(stored[r.doc_id]) and own.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest()


# --- quality scores by plain loops -------------------------------------------------------


def test_scores_are_sums_of_table_entries(spark, docs, odd_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_gam.train(docs, labels)
    assert model.pairs
    rows = docs.unionByName(odd_docs.select(docs.columns))
    got = Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in quality_gam.score(rows, model).collect())
    want = Counter()
    for r in rows.collect():
        x, total = quality_gam.features(r.text), model.base
        place = lambda edges, v: sum(1 for e in edges if e <= v)
        for k, v in enumerate(x):
            total += model.single[k][place(model.edges[k], v)]
        for (a, b), table in zip(model.pairs, model.double, strict=True):
            total += table[place(model.coarse[a], x[a])][place(model.coarse[b], x[b])]
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
        held_out = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        want[r.doc_id, held_out, round(p, 9), int(p >= 0.5)] += 1
    assert got == want


# --- names and hot ids -----------------------------------------------------------------------


def test_clashing_names(odd_docs):
    names = ["__text", "__key", "__source", "__whole", "__stop", "__copy", "__row", "row", "own_key", "own_copy", "_own_take"]
    df = odd_docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.count() == langid.keep_known(odd_docs).count()
    mixed = mixing.mix(df, 2.0, budget=50_000)
    assert mixed.columns == df.columns
    assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in mixed.collect() for n in names)


def test_a_source_of_one_doc_id(spark):
    """All rows without an id, most of them one text: counted first, only equal texts are numbered."""
    rows = [(None, "a b c", "x")] * 400 + [(None, f"t{k} b", "x") for k in range(50)] + [(k, "d " * 5000, "y") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for budget in (1500, 1000, 137):
        want = Counter((r.source, r.n_tokens) for r in mixing.mixture(df, 2.0, budget=budget).collect() for _ in range(r.copies))
        assert Counter((r.source, len(r.text.split())) for r in mixing.mix(df, 2.0, budget=budget).collect()) == want


def test_ids_of_one_doc_id_are_split(spark):
    df = spark.createDataFrame([(None, f"text {k}") for k in range(5000)], "doc_id long, text string").repartition(4)
    own = scratch.Scratch(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    blocks = bitpack.write_blocks(df, own, bitpack.tokens.default_path())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert blocks.groupBy("shard").count().count() > 1
    starts = sorted((r.start, r.n_tokens) for r in bitpack.documents(blocks).collect())
    assert len(starts) == 5000 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31])
def test_packing_in_slices(monkeypatch, bits):
    monkeypatch.setattr(bitpack, "SLICE", 16)
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint32)
    packed = bitpack.pack(ids, bits)
    assert len(packed) == -(-1003 * bits // 8) and (bitpack.unpack(packed, bits, 500, 503) == ids[500:]).all()


def test_steps_note_their_own_tables(spark):
    with scratch.collecting() as outer:
        scratch.Scratch(spark, "a")
        with scratch.collecting() as inner:
            scratch.Scratch(spark, "b")
        scratch.Scratch(spark, "c")
    scratch.Scratch(spark, "d")
    label = lambda xs: [x.root.rsplit("/", 1)[1][0] for x in xs]
    assert label(outer) == ["a", "c"] and label(inner) == ["b"]
