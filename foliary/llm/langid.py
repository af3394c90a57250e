"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum, over all ways of segmenting it into pieces, of the
products of their probabilities; the forward algorithm computes its logarithm in one pass
over the word's characters. Training is expectation-maximisation: forward and backward sums give
each piece's expected count, Spark adds these up by language, and the sums are the next
probabilities. A text's score is the posterior of its best language.

Words are runs of letters (Unicode's category L, and the marks, M, that follow one), in lower case,
with the vocabulary's space mark before them; digits, numerals and fractions are no letters. Single
characters outside the vocabulary share one more piece.

Training reads at most about `max_docs` labelled texts of each language, whole, chosen by
a hash; everything else reads every row. The model is vocabulary x languages.

A word is summed over whole, however long it is: past `LONG` letters piece by piece, with no
table of all its places. Any number of languages can be learned; a task holds pieces x
languages numbers (180 KB a language), the model itself.

Edge cases: null texts and texts without a letter are `und` with score 0; rows whose lang or
doc_id is null are predicted but never learned from, and a null doc_id isn't held out;
without any labelled text everything is `und`; ties go to the language that sorts first;
repeated rows are scored like any other; lang, source and other columns are never inputs of
a prediction.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import tokens
from foliary.llm.scratch import Scratch

#: In ASCII texts; in others without marks, where runs may hold numerals; in all.
ASCII_WORD, RUN, WORD = re.compile(r"[a-z]+"), re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
MARK = "▁"
#: Words of more letters are summed over one place after another.
LONG = 4096
#: Numbers in a table of words x places x languages.
TABLE = 1 << 20
#: Words whose scores a task remembers (about 150 bytes each), and letters in them; at either bound it starts anew.
REMEMBERED, REMEMBERED_LETTERS = 600_000, 8_000_000
#: Languages whose shares may be broadcast (about 40 bytes each).
BROADCAST_LANGS = 100_000
#: Added to every piece's expected count.
PRIOR_COUNT = 0.01
ROUNDS = 3


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters only, in lower case, with or without the mark; the last id is for other characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    own = {p for p in found if p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha())} | {MARK}
    return {p: i for i, p in enumerate(sorted(own))}


@lru_cache(maxsize=1)
def marked() -> re.Pattern:
    """What only texts with marks hold: marks up to U+FFFF, and anything beyond that."""
    marks = [k for k in range(0x10000) if unicodedata.category(chr(k))[0] == "M"]
    return re.compile("[" + "".join(re.escape(chr(k)) for k in marks) + "\U00010000-\U0010ffff]")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words. Most texts are read by a pattern that is fast and, of them, right."""
    low = (text or "").lower()
    if low.isascii():
        return ASCII_WORD.findall(low)
    if marked().search(low):
        return WORD.findall(low)
    found = RUN.findall(low)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else WORD.findall(run))]


@lru_cache(maxsize=2)
def beginnings(path: str) -> dict[str, int]:
    """The pieces with their ids, and whatever a longer piece begins with, with -1."""
    vocab = vocabulary(path)
    return {p[:m]: -1 for p in vocab for m in range(1, len(p))} | vocab


def lattice(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(word, start, end, piece) of every piece that stands in a word, by end and word; and the
    words' sizes. The id after the last piece's stands for any other character, so every place
    of a word is a start and an end."""
    get, other = beginnings(path).get, len(vocabulary(path))
    found = array("q")
    for k, word in enumerate(words):
        marked = MARK + word
        n = len(marked)
        for i in range(n):
            piece = get(marked[i])
            found.extend((k, i, i + 1, other if piece is None or piece < 0 else piece))
            j = i + 2
            while piece is not None and j <= n:
                piece = get(marked[i:j])
                if piece is not None and piece >= 0:
                    found.extend((k, i, j, piece))
                j += 1
    edges = np.frombuffer(found, dtype=np.int64).reshape(-1, 4)
    return edges[np.lexsort((edges[:, 0], edges[:, 2]))], np.array([len(w) + 1 for w in words])


def spread(total: np.ndarray, at: np.ndarray, come: np.ndarray, to: np.ndarray, word: np.ndarray, log_p: np.ndarray) -> None:
    """Log of the summed probability of all ways to each (word, to), place after place: total[word,
    come] of each edge times its piece. The edges of a place stand from at[k] to at[k + 1], by word."""
    for low, high in zip(at[:-1], at[1:], strict=True):
        w = word[low:high]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        ways = total[w, come[low:high]] + log_p[low:high]
        top = np.maximum.reduceat(ways, first)
        ways -= np.repeat(top, np.diff(first, append=len(w)), axis=0)
        total[w[first], to[low]] = top + np.log(np.add.reduceat(np.exp(ways), first))


def places(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins, and the end."""
    return np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x))


def forward(edges: np.ndarray, size: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each prefix: words x places x languages."""
    alpha = np.zeros((len(size), size.max() + 1, log_p.shape[1]))
    word, start, end, piece = edges.T
    spread(alpha, places(end), start, end, word, log_p[piece])
    return alpha


def parts_of(words: list[str], languages: int) -> Iterator[list[int]]:
    """Places of words of like sizes, so many at once that their tables stay small."""
    part: list[int] = []
    for k in sorted(range(len(words)), key=lambda k: len(words[k])):
        if part and (len(part) == 2000 or (len(part) + 1) * (len(words[k]) + 2) * languages > TABLE):
            yield part
            part = []
        part.append(k)
    if part:
        yield part


def long_score(word: str, log_p: np.ndarray, path: str) -> np.ndarray:
    """Log probability of one word in each language. Sums are held for as many places as the longest piece has."""
    get, other, marked = beginnings(path).get, len(vocabulary(path)), MARK + word
    ahead: list[np.ndarray | None] = [None] * (max(map(len, vocabulary(path))) + 1)
    ahead[0] = np.zeros(log_p.shape[1])
    for i in range(len(marked)):
        here, ahead[i % len(ahead)] = ahead[i % len(ahead)], None
        piece, j = get(marked[i]), i + 1
        ends = [(j, other if piece is None or piece < 0 else piece)]
        while piece is not None and j < len(marked):
            j += 1
            piece = get(marked[i:j])
            if piece is not None and piece >= 0:
                ends.append((j, piece))
        for end, own in ends:
            was, ways = ahead[end % len(ahead)], here + log_p[own]
            ahead[end % len(ahead)] = ways if was is None else np.logaddexp(was, ways)
    return ahead[len(marked) % len(ahead)]


def word_scores(words: list[str], log_p: np.ndarray, path: str) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), log_p.shape[1]))
    for part in parts_of(words, log_p.shape[1]):
        if len(words[part[-1]]) > LONG:
            for k in part:
                out[k] = long_score(words[k], log_p, path)
            continue
        edges, size = lattice([words[k] for k in part], path)
        out[part] = forward(edges, size, log_p)[np.arange(len(part)), size]
    return out


def expected_counts(words: list[str], times: np.ndarray, log_p: np.ndarray, path: str) -> np.ndarray:
    """Of one language: each piece's expected number over all segmentations of all words."""
    out = np.zeros(len(log_p))
    for part in parts_of(words, 1):
        edges, size = lattice([words[k] for k in part], path)
        alpha = forward(edges, size, log_p[:, None])
        beta = np.zeros_like(alpha)
        word, start, end, piece = edges[np.lexsort((edges[:, 0], -edges[:, 1]))].T
        spread(beta, places(start), end, start, word, log_p[piece, None])
        share = np.exp(alpha[word, start, 0] + log_p[piece] + beta[word, end, 0] - alpha[word, size[word], 0])
        out += np.bincount(piece, share * times[part][word], len(out))
    return out


def labelled(docs: DataFrame, learn: Column, max_docs: int) -> DataFrame:
    """lang, text of about max_docs rows of each language, chosen by a hash of doc_id."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = rows.groupBy("lang").agg((F.lit(max_docs) / F.count("*")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_LANGS else shares  # a row a language, as in the model
    return rows.join(shares, "lang").where(chance < F.col("share")).select("lang", "text")


def train(docs: DataFrame, learn: Column, path: str | None = None, max_docs: int = 1500, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log piece probabilities: pieces x languages, log priors)."""
    path, scratch = path or default_path(), Scratch(docs.sparkSession, "langid")
    pieces = len(vocabulary(path)) + 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(*tokens.columns(batch, "lang", "text"), strict=True):
                by.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "word", "n"])

    counts = labelled(docs, learn, max_docs).mapInArrow(tally, "lang string, word string, n long")
    counts = scratch.save(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((pieces, 0)), np.zeros(0)
    log_p = np.full((pieces, len(langs)), -np.log(pieces))
    for _ in range(rounds):
        now, column = log_p, {x: k for k, x in enumerate(langs)}

        def expect(frames: Iterator[pd.DataFrame], now=now, column=column) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for lang, own in pdf.groupby("lang"):
                    got = expected_counts(own["word"].tolist(), own["n"].to_numpy(), now[:, column[lang]], path)
                    used = np.flatnonzero(got)
                    yield pd.DataFrame({"lang": lang, "piece": used, "n": got[used]})

        # As many rows as pieces and languages, whatever the input.
        total = np.full((pieces, len(langs)), PRIOR_COUNT)
        for r in counts.mapInPandas(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            total[r["piece"], column[r["lang"]]] += r["n"]
        log_p = np.log(total / total.sum(axis=0))
    scratch.close()
    prior = np.array([sums[x] for x in langs], dtype=float)
    return langs, log_p, np.log(prior / prior.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """docs' columns with lang_pred and score added; text is all that it looks at. remembered: words whose
    scores a task keeps at most."""
    langs, log_p, prior = model
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast((langs, log_p, prior))  # pieces x languages, bounded

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p, prior = shared.value
        place: dict[str, int] = {}
        letters = 0
        known = np.zeros((0, len(langs)), dtype=np.float32)
        for batch in batches:
            texts = [Counter(words_of(t)) for t in tokens.columns(batch, "text")[0]]
            fresh = list(set().union(*texts) - place.keys())
            if len(place) + len(fresh) > remembered or letters > REMEMBERED_LETTERS:
                place, known, letters = {}, known[:0], 0
                fresh = list(set().union(*texts))
            letters += sum(map(len, fresh))
            if fresh and langs:
                place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
                known = np.concatenate([known, word_scores(fresh, log_p, path).astype(np.float32)])
            names, scores = [], []
            for c in texts:
                if not c or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                at = np.fromiter(map(place.__getitem__, c), np.int64, len(c))
                sums = prior + np.fromiter(c.values(), np.float64, len(c)) @ known[at].astype(np.float64)
                best = int(sums.argmax())
                names.append(langs[best])
                scores.append(float(1 / np.exp(sums - sums[best]).sum()))
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
        del place, known
        tokens.release()

    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "lang_pred string, score double"])
    return docs.mapInArrow(score, schema)


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def learnable() -> Column:
    """Rows that a model may learn from; a quarter, by a checksum of doc_id, is held out."""
    return F.coalesce(remainder() != 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = train(docs.select("doc_id", "text", "lang"), learnable())
    rows = docs.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model)


def keep_known(docs: DataFrame, least: float = 0.5, remembered: int = REMEMBERED) -> DataFrame:
    """The rows whose language is told with a posterior of at least `least`; the columns stay as they are."""
    model = train(docs.select("doc_id", "text", "lang"), learnable())
    names = docs.columns
    # The row goes along as one column, so no name of its can clash.
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    return predict(carried, model, remembered=remembered).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
