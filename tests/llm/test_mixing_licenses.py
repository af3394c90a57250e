"""Mixing and license scans against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest

from foliary.llm import license_join, mixing


def key(doc_id):
    return int(hashlib.md5(("mix" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()[:15], 16)


def plan(rows, max_repeats):
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source or ""] += len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or ""))
    n = sum(tokens.values())
    shares = {s: t / n for s, t in tokens.items() if t}
    low, high = 0.0, 1.0
    spread = lambda a: max(q ** (a - 1) for q in shares.values()) / min(q ** (a - 1) for q in shares.values())
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if spread(middle) <= max_repeats else (middle, high)
    a = 0.0 if spread(0.0) <= max_repeats else high
    weights = {s: q**a for s, q in shares.items()}
    weights = {s: w / sum(weights.values()) for s, w in weights.items()}
    budget = max(tokens[s] / w for s, w in weights.items())
    return tokens, {s: round(w * budget) for s, w in weights.items()}


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
@pytest.mark.parametrize("max_repeats", [1.25, 2.0, 50.0])
def test_copies(name, max_repeats, request, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 3)
    df = request.getfixturevalue(name)
    rows = df.collect()
    tokens, budgets = plan(rows, max_repeats)
    got = mixing.mixture(df, max_repeats).collect()
    assert len(got) == len(rows) and all(r.copies >= 1 for r in got)
    for source, budget in budgets.items():
        own = sorted((r for r in got if r.source == source), key=lambda r: (key(r.doc_id), r.doc_id is not None, r.doc_id or 0, r.n_tokens))
        at = 0
        for r in own:
            assert r.place == at
            assert r.copies == budget // tokens[source] + (at < budget % tokens[source])
            at += r.n_tokens
    mixed = mixing.mix(df, max_repeats)
    assert mixed.columns == df.columns
    count = lambda pairs: sorted(pairs, key=str)
    assert count([(r.doc_id, r.source or "") for r in mixed.collect()]) == count([(r.doc_id, r.source) for r in got for _ in range(r.copies)])


def test_target_entropy(docs):
    import math

    got = {r.source: r.weight for r in mixing.mixture(docs, None, entropy=0.999).collect()}
    assert abs(-sum(w * math.log(w) for w in got.values()) / math.log(len(got)) - 0.999) < 0.001


def test_many_sources(spark):
    """Thousands of sources take no longer than a few; weights are the powers of the shares."""
    import time

    df = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 37 AS int)) AS text", "concat('s', id % 3000) AS source")
    for options in ({"max_repeats": 1.5}, {"max_repeats": None, "entropy": 0.99}):
        began = time.time()
        got = mixing.mixture(df, **options).collect()
        assert time.time() - began < 120 and len(got) == 6000
        weights = {r.source: r.weight for r in got}
        assert abs(sum(weights.values()) - 1) < 1e-2 and len(weights) == 3000


def test_entropy_of_two(spark):
    import math

    df = spark.createDataFrame([(1, "a " * 90, "x"), (2, "a " * 10, "y")], "doc_id long, text string, source string")
    got = {r.source: r.weight for r in mixing.mixture(df, None, entropy=0.9).collect()}
    assert abs(-sum(w * math.log(w) for w in got.values()) / math.log(2) - 0.9) < 1e-4


@pytest.mark.parametrize("like", [3, 65_536])
def test_rows_of_one_doc_id(spark, like, monkeypatch):
    monkeypatch.setattr(mixing, "LIKE", like)
    monkeypatch.setattr(mixing, "STRIP", 2)
    rows = [(None, f"{'a ' * (k % 3)}b", "x") for k in range(40)] + [(7, "c c", "x")] * 9 + [(k, "d " * 50, "y") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(df, 2.0, budget=130).collect()
    for source in ("x", "y"):
        own = sorted((r.place, r.n_tokens) for r in got if r.source == source)
        at = 0
        for place, n in own:
            assert place == at
            at += n
    mixed = mixing.mix(df, 2.0, budget=130)
    count = lambda rows: sorted(rows, key=str)
    assert count((r.doc_id, r.source, len(r.text.split())) for r in mixed.collect()) == count((r.doc_id, r.source, r.n_tokens) for r in got for _ in range(r.copies))


def test_budget_can_be_less_than_all(docs):
    got = mixing.mixture(docs, 2.0, budget=1000).collect()
    assert {r.copies for r in got} == {0, 1}
    assert 1000 <= sum(r.n_tokens for r in got if r.copies) + 20 * 3


def test_empty(no_docs):
    assert mixing.mixture(no_docs).count() == mixing.mix(no_docs).count() == license_join.scan_licenses(no_docs).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan(text, templates, threshold):
    text = (text or "").translate(LOWER)
    words = WORD.findall(text)
    hits = []
    for phrase, label in license_join.PHRASES.items():
        own = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    base = {label for _, label in hits}
    shares = stretches(text, templates, threshold)
    at = [i for i, _ in hits]
    score = 1.0 if hits else max(shares.values(), default=0.0)
    return (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(shares))), score)


@pytest.mark.parametrize("name", ["docs", "odd_docs"])
@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_scans(name, threshold, request):
    df = request.getfixturevalue(name)
    got = [tuple(r) for r in license_join.scan_licenses(df, threshold=threshold).collect()]
    want = [(r.doc_id, *scan(r.text, license_join.TEMPLATES, threshold)) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_phrases_side_by_side(spark):
    texts = ["cc by cc by", "CC-BY", "cc bye", "x\x00cc\tby.", "all rights  reserved all rights reserved", "ÀCC BY", "cc by é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in license_join.scan_licenses(df).orderBy("doc_id").collect()]
    assert got == [(k, *scan(t, license_join.TEMPLATES, 0.8)) for k, t in enumerate(texts)]


def stretches(text, templates, threshold):
    words = WORD.findall((text or "").translate(LOWER))
    shares = {}
    for label, t in templates:
        own = set(t.split())
        for i in range(len(words)):
            share = len(own & set(words[i : i + license_join.reach(t)])) / len(own)
            if share >= threshold - 1e-9:
                shares[label] = max(share, shares.get(label, 0))
    return shares


def test_notices_across_lines(spark):
    import random
    import textwrap

    r = random.Random(4)
    notices = [t for _, t in license_join.TEMPLATES]
    filler = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    texts = [textwrap.fill(" ".join(filler(7) + [t] + filler(30)), width) for t in notices for width in (20, 80)]
    texts.append("Released " + " ".join(filler(40)) + " under " + " ".join(filler(40)) + " the MIT license")
    for _ in range(40):
        words = [w for t in r.sample(notices, 3) for w in t.split() if r.random() < 0.85]
        for _ in range(r.randrange(30)):
            words.insert(r.randrange(len(words)), f"w{r.randrange(9)}")
        texts.append("".join(w + r.choice("  \n") for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.8, 0.5):
        got = license_join.scan_licenses(df, threshold=threshold).orderBy("doc_id").collect()
        for row, text in zip(got, texts, strict=True):
            want = stretches(text, license_join.TEMPLATES, threshold)
            assert set(filter(None, row.labels.split(","))) == set(want) | set(filter(None, row.base_labels.split(",")))
            assert row.score == (1.0 if row.n_base else max(want.values(), default=0.0))
    got = license_join.scan_licenses(df).orderBy("doc_id").collect()
    for k, (label, _) in enumerate(license_join.TEMPLATES):
        assert label in got[2 * k].labels.split(",") and label in got[2 * k + 1].labels.split(",")
    assert got[2 * len(notices)].labels == ""


@pytest.mark.parametrize("mark", ["\u0085", "\u2028", "\u2029"])
def test_phrases_beside_separators(spark, mark):
    texts = [f"a {mark} cc by", f"cc by {mark} all rights reserved b", f"{mark}cc by", f"x{mark}y cc by\n{mark}\ncc by {mark}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in license_join.scan_licenses(df).orderBy("doc_id").collect()]
    assert got == [(k, *scan(t, license_join.TEMPLATES, 0.8)) for k, t in enumerate(texts)]
