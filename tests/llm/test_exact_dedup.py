"""Exact groups against a plain grouping, and the filters by themselves."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from foliary.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        text = r.text or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text).encode()).hexdigest()].append((-len(text), r.doc_id is None, r.doc_id))
    out = []
    for sha, own in groups.items():
        keep = min(own, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out += [(doc_id, keep, len(own), doc_id == keep, sha) for _, _, doc_id in own]
    return out


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_groups(name, request):
    df = request.getfixturevalue(name)
    got = [tuple(r) for r in exact_dedup.exact_dedup(df).collect()]
    assert sorted(got, key=str) == sorted(brute(df.collect()), key=str)


def test_drop_copies_keeps_one_of_each(odd_docs):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    squeeze = lambda t: re.sub(r"\s", "", t or "")
    texts = [squeeze(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({squeeze(r.text) for r in odd_docs.collect()})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 20_000])
def test_filter_has_no_false_negatives(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    built = exact_dedup.build_filter(np.concatenate([keys, keys[: n // 2]]))
    assert exact_dedup.probe_filter(keys, *built).all()
    others = np.random.default_rng(n + 1).integers(2**63, 2**64, 20_000, dtype=np.uint64)
    assert exact_dedup.probe_filter(others, *built).mean() < 0.02
    if n == 20_000:
        assert len(built[3]) < 1.35 * n


def test_unequal_bytes_stay_apart(spark, monkeypatch):
    """A digest shared by different texts, as a collision would."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, f"text {k % 2}") for k in range(1, 9)], "doc_id long, text string")
    real = exact_dedup.digests
    monkeypatch.setattr(exact_dedup, "digests", lambda d: real(d).withColumn("sha", F.lit("0" * 64)))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("0" * 64))
    from foliary.llm.scratch import Scratch

    got = exact_dedup.exact_groups(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.keep_id for r in got} == {k: 2 - k % 2 for k in range(1, 9)}


@pytest.mark.parametrize("answer", [False, True])
def test_the_filters_decide(docs, monkeypatch, answer):
    """A filter that knows nothing leaves the batch's classes apart from the snapshot's; one that
    says maybe to all costs comparisons only."""
    df = docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    monkeypatch.setattr(exact_dedup, "probe_filter", lambda keys, *f, yes=answer: np.full(len(keys), yes))
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert (got == sorted(brute(df.collect()), key=str)) == answer


def test_large_batches_are_shared_out(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_PROBE", 7)
    monkeypatch.setattr(exact_dedup, "KEYS_PER_FILTER", 30)
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(docs.collect()), key=str)
