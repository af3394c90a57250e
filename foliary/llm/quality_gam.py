"""Quality score by a generalised additive model with pairwise interactions.

Numbers that describe a text (shares of character kinds, word and line statistics,
repetition) are cut into bins. Cyclic boosting visits one feature after another; each
visit fits a shallow tree to the current residuals over the feature's bins and adds a
small step of it to the feature's lookup table. The pairs whose joint tables explain the
remaining residuals best then get tables of two dimensions the same way. A score is the
logistic of a sum of looked-up entries: one vector addition per table.

Training reads at most about `max_rows` labelled texts, whole, chosen by a hash; scoring
reads every row. The model is features x bins.

Edge cases: null and empty texts have features of zero and get the model's score for
them; rows without a label are scored and not learned from, labels other than 0 and 1 or
null are ignored, a doc_id with several labels counts once with their mean rounded up, and
one with several texts with the one that sorts first;
with no labels, or one kind only, the score is their smoothed share; repeated rows and null
doc_ids are scored like any other; labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import tokens
from foliary.llm.scratch import Scratch

NAMES = (
    "log_bytes", "log_words", "upper", "digit", "space", "newline", "other_ascii", "non_ascii", "period_comma", "bang", "pipe", "marks",
    "word_length", "distinct_words", "top_word", "same_neighbours", "distinct_lines", "line_words", "words_with_marks", "upper_words", "distinct_trigrams", "controls",
)
BINS = 32
PAIR_BINS = 8
PAIRS = 12
ROUNDS = 120
PAIR_ROUNDS = 40
STEP = 0.15
LEAVES = 4


def features(text: str | None) -> list[float]:
    """Numbers in the order of NAMES."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words = (text or "").split()
    n, w = max(len(raw), 1), max(len(words), 1)
    by = np.bincount(raw, minlength=256)
    kinds: dict[str, int] = {}
    for word in words:
        kinds[word] = kinds.get(word, 0) + 1
    same = sum(map(str.__eq__, words, words[1:]))
    lines = (text or "").split("\n")
    grams = len(set(zip(words, words[1:], words[2:])))  # noqa: B905
    marks = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), by[65:91].sum() / n, by[48:58].sum() / n, by[32] / n, by[10] / n,
        (marks - by[46] - by[44]) / n, by[128:].sum() / n, (by[46] + by[44]) / n, by[33] / n, by[124] / n, (by[35:39].sum() + by[42]) / n,
        len(raw) / w, len(kinds) / w, max(kinds.values(), default=0) / w, same / w, len(set(lines)) / len(lines), w / len(lines),
        sum(not x[-1].isalnum() for x in words) / w, sum(map(str.isupper, words)) / w, grams / w, by[:9].sum() / n,
    ]


class Model:
    """Bin edges by feature, lookup tables by feature and by pair of features."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.single = np.zeros((len(edges), BINS))
        self.coarse = [e[:: max(1, len(e) // (PAIR_BINS - 1))][: PAIR_BINS - 1] for e in edges]
        self.pairs: list[tuple[int, int]] = []
        self.double = np.zeros((0, PAIR_BINS, PAIR_BINS))

    def bins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)
        coarse = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.coarse)], axis=1)
        return fine, coarse

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x)
        total = np.full(len(x), self.base)
        for k in range(len(self.edges)):
            total += self.single[k][fine[:, k]]
        for (a, b), table in zip(self.pairs, self.double, strict=True):
            total += table[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def shallow_tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values over a feature's bins: split where it helps most, up to `leaves` runs of bins."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    ridge = 1.0
    gain = lambda i, j: (g[j] - g[i]) ** 2 / (h[j] - h[i] + ridge)
    runs = [(0, len(gradient))]
    while len(runs) < leaves:
        best = max(((gain(i, m) + gain(m, j) - gain(i, j), i, m, j) for i, j in runs for m in range(i + 1, j)), default=(0,))
        if best[0] <= 1e-9:
            break
        _, i, m, j = best
        runs = [r for r in runs if r != (i, j)] + [(i, m), (m, j)]
    out = np.zeros(len(gradient))
    for i, j in runs:
        out[i:j] = (g[j] - g[i]) / (h[j] - h[i] + ridge)
    return out


def joint_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """The best single cut in both directions of a two-dimensional histogram: its gain and values."""
    corner = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, h = corner(gradient), corner(hessian)
    n = len(gradient)
    best = (0.0, np.zeros_like(gradient))
    whole = g[n, n] ** 2 / (h[n, n] + 1)
    for i in range(1, n):
        for j in range(1, n):
            boxes = [(0, i, 0, j), (0, i, j, n), (i, n, 0, j), (i, n, j, n)]
            sums = [(g[b, d] - g[a, d] - g[b, c] + g[a, c], h[b, d] - h[a, d] - h[b, c] + h[a, c]) for a, b, c, d in boxes]
            gain = sum(x * x / (y + 1) for x, y in sums) - whole
            if gain > best[0]:
                table = np.zeros_like(gradient)
                for (a, b, c, d), (x, y) in zip(boxes, sums, strict=True):
                    table[a:b, c:d] = x / (y + 1)
                best = (gain, table)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of a table for each feature, then of tables for the best pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.array([]) for k in range(x.shape[1])]
    model = Model(edges, float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    fine, coarse = model.bins(x)
    total = np.full(len(y), model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            r, h = residuals()
            step = STEP * shallow_tree(np.bincount(fine[:, k], r, BINS), np.bincount(fine[:, k], h, BINS))
            model.single[k] += step
            total += step[fine[:, k]]
    r, h = residuals()
    joint = lambda a, b, v: np.bincount(coarse[:, a] * PAIR_BINS + coarse[:, b], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gains = sorted(((joint_tree(joint(a, b, r), joint(a, b, h))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    model.double = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            r, h = residuals()
            step = STEP * joint_tree(joint(a, b, r), joint(a, b, h))[1]
            model.double[k] += step
            total += step[coarse[:, a], coarse[:, b]]
    return model


def learnable() -> Column:
    """Rows that a model may learn from; a third, by a checksum of doc_id, is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(True))


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text -> label, features."""
    for batch in batches:
        texts = tokens.columns(batch, "text")[0]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([features(t) for t in texts], pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Model:
    """Learns from about max_rows labelled rows at most; their texts alone are read whole."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = labels.where(learnable() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.ceil(F.avg("quality")).cast("int").alias("label"))
    rows = scratch.save(rows.where("doc_id IS NOT NULL"), "labels")
    share = min(1.0, max_rows / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    # About max_rows rows of 12 bytes: a proven bound. A doc_id that stands in several rows gives one text.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text")
    table = texts.mapInArrow(measured, "label int, x array<double>").toArrow()
    scratch.close()
    x = np.array(table.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
    y = np.array(table.column("label").to_pylist(), dtype=float)
    order = np.lexsort([*x.T, y])  # rows arrive in any order; sums of floats depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; text is all that is scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in tokens.columns(batch, "text")[0]]).reshape(-1, len(NAMES))
            p = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (~learnable()).alias("held_out"), "text")
    return rows.mapInArrow(add, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
