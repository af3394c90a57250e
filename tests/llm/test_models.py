"""Language ID and quality: the recurrences against enumeration, and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import langid, quality_gam

PATH = langid.default_path()
LONGEST_WORD = 48


def segmentations(word, vocab):
    marked = langid.MARK + word

    def rest(at):
        if at == len(marked):
            yield []
        for m in range(1, len(marked) - at + 1):
            piece = vocab.get(marked[at : at + m], len(vocab) if m == 1 else None)
            if piece is not None:
                for more in rest(at + m):
                    yield [piece, *more]

    return list(rest(0))


def test_sums_over_all_segmentations():
    vocab, r = langid.vocabulary(PATH), np.random.default_rng(1)
    p = r.random((len(vocab) + 1, 2))
    p /= p.sum(axis=0)
    words = ["the", "straße", "日本", "a", "elephant", "zzzzq"]
    got = langid.word_scores(words, np.log(p), PATH)
    counts = np.zeros(len(vocab) + 1)
    for word, scores in zip(words, got, strict=True):
        ways = segmentations(word, vocab)
        probs = np.array([np.prod(p[way], axis=0) for way in ways])
        assert np.allclose(scores, np.log(probs.sum(axis=0)))
        for way, share in zip(ways, probs[:, 0] / probs[:, 0].sum(), strict=True):
            np.add.at(counts, way, 3 * share)
    assert np.allclose(langid.expected_counts(words, np.full(len(words), 3.0), np.log(p[:, 0]), PATH), counts)


def test_long_words_do_not_vanish():
    log_p = np.full((len(langid.vocabulary(PATH)) + 1, 2), -12.0)
    assert np.isfinite(langid.word_scores(["日" * LONGEST_WORD], log_p, PATH)).all()
    assert langid.words_of("é" * 1000 + " b") == ["é" * 1000, "b"]
    assert langid.words_of(None) == langid.words_of("12 _ !!") == []


def test_held_out_languages(more_docs):
    rows = langid.language_id(more_docs).join(more_docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == more_docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_odd_texts(odd_docs, no_docs):
    rows = {r.doc_id: r for r in langid.language_id(odd_docs).collect()}
    assert {k for k, r in rows.items() if r.lang_pred == "und"} == {1, 2, 3, 10}
    assert langid.language_id(no_docs).count() == 0
    unknown = langid.language_id(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_nothing_is_learned_from_held_out_rows(more_docs):
    swapped = more_docs.withColumn("lang", F.when(~langid.learnable(), "zz").otherwise(F.col("lang")))
    assert {r.lang_pred for r in langid.language_id(swapped).select("lang_pred").distinct().collect()} == {"de", "en", "es", "fr"}


def test_rejected_rows_go(odd_docs):
    kept = langid.keep_known(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})


def test_held_out_quality(spark, more_docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_gam.quality(more_docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_pairs_are_learned():
    r = np.random.default_rng(3)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9 and (0, 1) in model.pairs
    without = quality_gam.fit(x[:, [0, 2]], y)
    assert ((without.score(x[:, [0, 2]]) >= 0.5) == y).mean() < 0.65


def test_trees_are_shallow():
    tree = quality_gam.shallow_tree(np.array([1.0, 1, -1, -1, 5, 5, 0, 0]), np.ones(8))
    assert len(set(tree.tolist())) <= quality_gam.LEAVES


@pytest.mark.parametrize("labels", [[], [(5, None)], [(5, 1), (6, 1)], [(None, 0), (5, 7)]])
def test_few_labels(spark, odd_docs, labels):
    rows = quality_gam.quality(odd_docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_features_of_odd_texts():
    for text in (None, "", " ", "\n\n", "\x00", "é" * 10):
        assert len(quality_gam.features(text)) == len(quality_gam.NAMES) and np.isfinite(quality_gam.features(text)).all()


def test_runs_of_letters_no_language_knows(spark):
    vocab = langid.vocabulary(PATH)
    total = np.full((len(vocab) + 1, 2), langid.PRIOR_COUNT)
    for k, word in enumerate(["wort", "word"]):
        total[[vocab[langid.MARK], *map(vocab.get, word)], k] += 1_000_000
    log_p = np.log(total / total.sum(axis=0))
    run = "ሀ" * LONGEST_WORD
    assert "ሀ" not in vocab
    scores = langid.word_scores([run], log_p, PATH)
    assert np.allclose(scores, log_p[vocab[langid.MARK]] + LONGEST_WORD * log_p[len(vocab)])
    counts = langid.expected_counts([run], np.ones(1), log_p[:, 0], PATH)
    assert np.isclose(counts[len(vocab)], LONGEST_WORD) and np.isclose(counts[vocab[langid.MARK]], 1)
    df = spark.createDataFrame([(1, run), (2, f"word word {run} word {run * 3}"), (3, f"{run} wort")], "doc_id long, text string")
    rows = langid.predict(df, (["de", "en"], log_p, np.log([0.5, 0.5]))).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows][1:] == ["en", "de"] and all(0 <= r.score <= 1 for r in rows)


def test_all_pieces_of_the_vocabulary_are_summed():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    public = {model.id_to_piece(k) for k in range(model.get_piece_size())}
    public = {p for p in public if p == p.lower() and p.removeprefix(langid.MARK).isalpha()}
    vocab = langid.vocabulary(PATH)
    assert vocab.keys() == public | {langid.MARK} and max(map(len, public)) > 12
    r = np.random.default_rng(5)
    p = r.random((len(vocab) + 1, 3))
    p /= p.sum(axis=0)
    words = sorted((x.removeprefix(langid.MARK) for x in public), key=len)[-20:] + ["internationalization", "a"]
    for word, got in zip(words, langid.word_scores(words, np.log(p), PATH), strict=True):
        marked, sums = langid.MARK + word, [np.ones(3)]
        for j in range(1, len(marked) + 1):
            ends = [(i, vocab.get(marked[i:j], len(vocab) if j - i == 1 else None)) for i in range(j)]
            sums.append(sum(sums[i] * p[piece] for i, piece in ends if piece is not None))
        assert np.allclose(got, np.log(sums[-1]))


def forwards(word, p, vocab):
    """The sum over all segmentations by plain logarithms, place after place."""
    marked, sums = langid.MARK + word, [np.zeros(p.shape[1])]
    for j in range(1, len(marked) + 1):
        ends = [(i, vocab.get(marked[i:j], len(vocab) if j - i == 1 else None)) for i in range(max(0, j - 40), j)]
        sums.append(np.logaddexp.reduce([sums[i] + p[piece] for i, piece in ends if piece is not None]))
    return sums[-1]


def test_words_are_never_cut(monkeypatch):
    """Words of 60 letters and of thousands: one sum over all their segmentations."""
    vocab, r = langid.vocabulary(PATH), np.random.default_rng(6)
    p = r.random((len(vocab) + 1, 3))
    p = np.log(p / p.sum(axis=0))
    pieces = [x.removeprefix(langid.MARK) for x in vocab if len(x) > 2]
    words = ["".join(r.choice(pieces, 20))[:60], "".join(r.choice(pieces, 900)), "日本語" * 700, "a"]
    want = np.array([forwards(w, p, vocab) for w in words])
    assert np.allclose(langid.word_scores(words, p, PATH), want)
    monkeypatch.setattr(langid, "LONG", 0)
    assert np.allclose(langid.word_scores(words, p, PATH), want)
    monkeypatch.setattr(langid, "TABLE", 1)
    assert np.allclose(langid.word_scores(words, p, PATH), want)


def test_query_against_brute_force(docs, odd_docs):
    """Every row's language and posterior from the model, by a plain recursion over whole texts."""
    for df in (docs, odd_docs):
        df = df.select("doc_id", "text", "lang")
        langs, log_p, prior = langid.train(df, langid.learnable())
        vocab = langid.vocabulary(PATH)
        got = sorted(langid.language_id(df).collect(), key=str)
        assert len(got) == df.count()
        texts = {}
        for r in df.collect():
            texts.setdefault(r.doc_id, set()).add(r.text)
        known = {}
        for r in got:
            wanted = []
            for text in texts[r.doc_id]:
                words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
                if not words:
                    wanted.append(("und", 0.0))
                    continue
                sums = prior.copy()
                for w in words:
                    if w not in known:
                        known[w] = forwards(w, log_p, vocab)
                    sums = sums + known[w]
                share = np.exp(sums - np.logaddexp.reduce(sums))
                wanted.append((langs[int(share.argmax())], float(share.max())))
            assert any(r.lang_pred == lang and abs(r.score - score) < 1e-3 for lang, score in wanted)


def test_many_languages(spark):
    rows = [(k, f"{chr(0x61 + k % 26)}{chr(0x61 + k // 26 % 26)}wort " * 3, f"l{k:03d}") for k in range(600)]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 600 and len({r.lang_pred for r in got}) > 300
