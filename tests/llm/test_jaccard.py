"""Components against all pairs, and the parts that must not lose a link."""

import random
from itertools import combinations

import numpy as np
import pytest

from foliary.llm import jaccard_rtree as jr
from foliary.llm.scratch import Scratch


def sets_of(rows, k):
    out = []
    for r in rows:
        words = (r.text or "").encode().lower().split()
        out.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    return out


def brute(rows, k, num, den):
    sets = sets_of(rows, k)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if find(j) == find(i) and rows[j].doc_id is not None]
        out.append((r.doc_id, len(sets[i]), min(ids, default=None)))
    return out


def near_copies(spark):
    r = random.Random(11)
    rows = []
    for base in range(6):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([5, 9, 25, 60, 300]))]
        for _ in range(12):
            own = list(words)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = f"x{r.randrange(50)}"
            rows.append((len(rows), " ".join(own + words[: r.randrange(3)])))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs", "near"])
@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 80, 100)])
def test_components(name, k, num, den, request, spark):
    df = near_copies(spark) if name == "near" else request.getfixturevalue(name)
    got = [tuple(r) for r in jr.jaccard_components(df, k, num, den).collect()]
    assert sorted(got, key=str) == sorted(brute(df.collect(), k, num, den), key=str)


@pytest.mark.parametrize("num, den", [(85, 100), (80, 100), (50, 100)])
def test_linked_sets_share_a_key(num, den):
    limits, r = jr.Limits(num, den), np.random.default_rng(num)
    for n in [1, 2, 5, 6, 7, 20, 23, 24, 25, 35, 36, 80, 300, 2000]:
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            gone = int(r.integers(0, limits.missing(n) + 1))
            more = r.integers(0, 2**63, int(r.integers(0, limits.differ(n) + 1)), dtype=np.uint64)
            b = np.unique(np.concatenate([r.permutation(a)[gone:], more]))
            shared = len(np.intersect1d(a, b))
            if den * shared >= num * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
                assert len(np.intersect1d(limits.keys(a), limits.keys(b)))


def test_tree_finds_all_pairs_the_bound_allows():
    r, limits = np.random.default_rng(2), jr.Limits(85, 100)
    base = r.poisson(4, (40, jr.GROUPS))
    points = np.maximum(base[r.integers(0, 40, 400)] + r.integers(-1, 2, (400, jr.GROUPS)) * (r.random((400, jr.GROUPS)) < 0.1), 0)
    n, comp = points.sum(axis=1), r.integers(0, 30, 400)
    want = {(i, j) for i, j in combinations(range(400), 2) if comp[i] != comp[j] and np.minimum(points[i], points[j]).sum() >= limits.need(n[i] + n[j]) and min(n[i], n[j]) * 100 >= 85 * max(n[i], n[j])}
    found = lambda side=None: [tuple(sorted(p)) for i, j in jr.tree_pairs(points, n, comp, limits, side) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(found()) == want and len(want) > 20
    side = r.integers(0, 2, 400)
    assert set(found(side)) == {(i, j) for i, j in want if side[i] != side[j]} and len(found(side)) == len(set(found(side)))


@pytest.mark.parametrize("table", [0, 1 << 20])
def test_exact_overlaps(table, monkeypatch):
    monkeypatch.setattr(jr, "TABLE_BYTES", table)
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    got = jr.overlaps(np.concatenate(sets), np.array(list(map(len, sets))))(i, j)
    assert got.tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)]


def test_a_hub_of_near_copies(spark, monkeypatch):
    """5,000 near copies of one text, some apart from it, in one family of several buckets."""
    monkeypatch.setattr(jr, "CELL", 1024)
    r, words = random.Random(3), [f"w{i}" for i in range(60)]
    rows = []
    for d in range(5000):
        own = list(words)
        for _ in range(r.choice([1, 1, 1, 2, 4])):
            own[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.component_id for x in jr.jaccard_components(df).collect()}
    sets = [jr.shingles(t, 4, jr.Words()) for _, t in rows]
    flat, n = np.concatenate(sets), np.array(list(map(len, sets)))
    overlap, comp = jr.overlaps(flat, n), np.arange(5000)
    for i in range(5000):  # all pairs
        j = np.arange(i + 1, 5000)
        both = overlap(np.full(len(j), i), j)
        for x in np.unique(comp[j[100 * both >= 85 * (n[i] + n[j] - both)]]):
            low, high = sorted((x, comp[i]))
            comp[comp == high] = low
    assert got == dict(enumerate(comp.tolist())) and 1 < len(set(comp)) < 4000


@pytest.mark.parametrize("shingles", [1 << 19, 100])
def test_large_families_are_split_into_cells(spark, monkeypatch, shingles):
    monkeypatch.setattr(jr, "CELL", 3)
    monkeypatch.setattr(jr, "CELL_SHINGLES", shingles)
    df = near_copies(spark)
    assert sorted(tuple(r) for r in jr.jaccard_components(df).collect()) == sorted(brute(df.collect(), 4, 85, 100))


def test_keys_over_many_tasks(spark):
    """Runs of a key in several tasks are one group; keys with the same classes are one."""
    rows = [(c, key) for key in (5, 6) for c in range(300)] + [(1000 + c, key) for key in (7, 8, 9) for c in range(3)] + [(2000, 10)]
    df = spark.createDataFrame(rows, "class long, key long").repartition(7)
    groups = {}
    for r in jr.shared_groups(df).collect():
        groups.setdefault(r.group, set()).add(getattr(r, "class"))
    found = [g for g in groups.values() if len(g) > 1]
    assert set(range(300)) in found and {1000, 1001, 1002} in found
    assert all(g <= set(range(300)) or g == {1000, 1001, 1002} for g in found) and len(found) <= 6


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_whole_runs(size):
    import pyarrow as pa

    r = np.random.default_rng(size)
    a, b = np.sort(r.integers(0, 12, 200)), np.zeros(200, dtype=np.int64)
    table = pa.table({"a": a, "b": b, "v": np.arange(200)})
    got = list(jr.whole_runs(iter(table.to_batches(max_chunksize=size)), "a", "b"))
    assert np.concatenate([x[2] for x, *_ in got]).tolist() == list(range(200))
    starts = [int(x[0][at]) for x, cut, *_ in got for at in cut[:-1]]
    assert starts == sorted(set(a.tolist()))
    assert [f for *_, f, _ in got] == [k == 0 for k in range(len(got))] and [z for *_, z in got] == [k == len(got) - 1 for k in range(len(got))]


def test_chains_are_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in jr.components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100}


def test_one_of_each_group_stays(more_docs):
    kept = {r.doc_id for r in jr.drop_near_copies(more_docs).select("doc_id").collect()}
    assert kept == {c for _, _, c in brute(more_docs.collect(), 5, 80, 100)}


def test_near_copies_of_repeated_and_null_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [
        (1, text("a")),
        (2, text("a") + " tail"),  # a near copy
        (2, text("b")),  # the same id, a text of its own
        (None, text("a") + " end"),
        (None, text("c")),
        (None, text("c") + " tail"),
        (None, text("d")),
        (3, text("e")),
        (3, text("e") + " tail"),
        (4, text("f")),
        (4, text("f")),
        (4, text("g")),
        (5, None),
        (5, None),
        (None, ""),
    ]
    kept = jr.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.text and r.text.removesuffix(" tail")) for r in kept), key=str)
    want = [(1, text("a")), (2, text("b")), (None, text("c")), (None, text("d")), (3, text("e")), (4, text("f")), (4, text("g")), (5, None), (5, None), (None, "")]
    assert got == sorted(want, key=str)
