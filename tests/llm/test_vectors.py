"""Operators on embeddings against all pairs, plain loops and SQL."""

import hashlib
import math
import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from foliary.llm import drake_kmeans, hard_negatives, nn_descent, vectors
from foliary.llm.catalog import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, score double, class string, bucket int, code long"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="float"):
    """(vec_id, vector, label) with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 0.5, "x", 3, 4) for r in rows], SCHEMA.replace("float", kind)).repartition(3)


def odd_rows(dim=64):
    r = np.random.default_rng(5)
    vec = lambda: (r.standard_normal(dim) / 8).tolist()
    same = vec()
    rows = [(k, vec(), k % 4) for k in range(230)]
    rows += [(300 + k, same, k % 3) for k in range(6)]  # ties
    rows += [(400, same, 1), (400, same, 1), (400, vec(), 0)]  # repeated ids
    rows += [(None, vec(), 1), (501, None, 1), (502, vec(), None), (503, [], 1), (504, [None] + vec()[1:], 1), (505, [NAN] + vec()[1:], 2), (506, [INF] + vec()[1:], 2)]
    rows += [(600, [0.0] * dim, 1), (650, vec()[:10], 1), (651, vec()[:10], 1), (652, vec()[:10], 2), (700, [-x for x in vec()], None), (-50, vec(), 2)]
    return rows


def whole(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def ints(v, cast=np.float32):
    return tuple(math.floor(256 * float(cast(x))) for x in v)


# --- hard negatives ---------------------------------------------------------------


def brute_negatives(rows, cast=np.float32):
    own = defaultdict(list)
    for i, v, label in rows:
        if i is not None and label is not None and whole(v) and sum(x * x for x in ints(v, cast)) < 2**60:
            own[i].append(((int(math.fmod(label + 1, 10)) if i % 7 == 0 else label), [float(cast(x)) for x in v]))
    data = {i: (min(v)[0], ints(min(v)[1], cast)) for i, v in own.items()}
    out = []
    for a, (label, v) in data.items():
        if a % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in data.items() if i != a and len(w) == len(v)]
        scores.sort()
        for p, positive, _ in [s for s in scores if s[2] == label][:5]:
            fit = [s for s in scores if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, positive, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 2])
def test_negatives_of_odd_rows(spark, block):
    rows = odd_rows()
    got = hard_negatives.hard_negatives(frame(spark, rows), block=block)
    assert got.columns == hard_negatives.OUT
    found = sorted(tuple(r) for r in got.collect())
    assert found == brute_negatives(rows) and len(found) > 20


def test_negatives_by_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SCORES", 64)
    rows = odd_rows()
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows)).collect()) == brute_negatives(rows)


def test_negatives_beyond_exact_doubles(spark):
    r = np.random.default_rng(1)
    base = r.integers(1, 1 << 20, (40, 8)) * 1.0
    rows = [(k, (base[k % 40] + k).tolist(), k % 3) for k in range(120)] + [(1000, [1e30] * 8, 1), (1050, [1e300] * 8, 1)]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows, "double")).collect())
    assert got == brute_negatives(rows, float) and max(r[4] for r in got) > 2**53


def test_percent_is_exact():
    for s in [0, 1, -1, 99, -101, 2**60 - 1, -(2**60) + 7]:
        for p in (50, 95):
            assert hard_negatives.percent(np.array([s]), p)[0] == p * s // 100


# --- clusters ----------------------------------------------------------------------


def brute_clusters(rows, k=40, rounds=5, dim=64, cast=np.float32):
    own = [(i, ints(v, cast)) for i, v, _ in rows if whole(v) and len(v) == dim]
    own = [(i, v) for i, v in own if sum(x * x for x in v) < 2**60]
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)
    centroids = [v for _, v in hashed[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in own:
            groups[nearest(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)) if groups[n] else c for n, c in enumerate(centroids)]
    final = [(i, *nearest(v)) for i, v in own]
    inertia = defaultdict(int)
    for _, d, c in final:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, d, c in final), key=str)


def test_clusters_of_odd_rows(spark):
    rows = odd_rows()
    got = drake_kmeans.clusters(frame(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 39, 41])
def test_few_vectors(spark, n):
    rows = [r for r in odd_rows() if r[0] is not None and 0 <= r[0] < n]
    assert sorted((tuple(r) for r in drake_kmeans.clusters(frame(spark, rows)).collect()), key=str) == brute_clusters(rows)


def test_ties_and_large_components(spark):
    r = np.random.default_rng(2)
    grid = [(k, r.integers(0, 2, 4).tolist(), 0) for k in range(200)]  # few places: ties and empty clusters
    grid += [(1000 + k, (r.integers(-(2**18), 2**18, 4) * 64).tolist(), 0) for k in range(60)] + [(5000, [1e12] * 4, 0)]
    grid = [(i, [float(x) for x in v], c) for i, v, c in grid]
    got = drake_kmeans.clusters(frame(spark, grid, "double"), k=12, dim=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(grid, k=12, dim=4, cast=float)


def test_bounds_spare_scans_and_stay_exact(monkeypatch):
    r = np.random.default_rng(3)
    m = np.floor(r.standard_normal((4000, 16)) * 100 + r.integers(0, 20, 4000)[:, None] * 60)
    centroids = m[:24].copy()
    scan = drake_kmeans.Scan(m, centroids, 6)
    state = {"cluster": scan.cluster, "near": scan.near, "low": scan.low, "rest": scan.rest}
    scanned, real = [], drake_kmeans.Scan
    monkeypatch.setattr(drake_kmeans, "Scan", lambda m, c, keep: (scanned.append(len(m)), real(m, c, keep))[1])
    keep = 6
    for _ in range(8):
        new = np.array([np.floor(m[state["cluster"] == c].mean(axis=0)) if (state["cluster"] == c).any() else centroids[c] for c in range(24)])
        moves, centroids = np.sqrt(((new - centroids) ** 2).sum(axis=1)), new
        keep = min(keep, 5)
        state = drake_kmeans.moved_on(m, state, centroids, moves, keep)
        d = drake_kmeans.distances(m, centroids)
        assert (state["cluster"] == d.argmin(axis=1)).all() and (state["distance"] == d.min(axis=1)).all()
        rows = np.arange(len(m))
        assert (state["low"] <= np.sqrt(d[rows[:, None], state["near"]])).all()
        others = np.ones(d.shape, dtype=bool)
        others[rows, state["cluster"]] = False
        others[rows[:, None], state["near"]] = False
        assert (state["rest"] <= np.sqrt(np.where(others, d, 2**60)).min(axis=1)).all()
    assert sum(scanned[-3:]) < len(m)  # of 3 * 4000


# --- near duplicates ----------------------------------------------------------------


def brute_links(rows, link=0.9):
    good = [k for k, (_, v, _) in enumerate(rows) if whole(v) and any(v)]
    links = defaultdict(set)
    for dim in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in own], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= link, 1)), strict=True):
            links[own[a]].add(own[b])
            links[own[b]].add(own[a])
    out, seen = [], set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()]:
                if n not in group:
                    group.add(n)
                    todo.append(n)
        seen |= group
        ids = [rows[g][0] for g in group if rows[g][0] is not None]
        first = min(ids) if ids else None
        for g in group:
            own = rows[g][0]
            out.append((own, len(links[g]), first, own == first if None not in (own, first) else not links[g]))
    return sorted(out, key=str)


def crowd(r, n, spread, dim=64):
    centre = r.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    return [(centre + spread * r.standard_normal(dim) / dim**0.5).tolist() for _ in range(n)]


def crowded(seed=0, hot=400):
    """Copies, a dense crowd of a third of the rows, crowds about as wide as a link, chains, and loners."""
    r = np.random.default_rng(seed)
    all_of = crowd(r, hot, 0.1) + crowd(r, 40, 0.33) + crowd(r, 60, 0.36) + [crowd(r, 1, 0)[0]] * 50
    for _ in range(150):
        all_of += crowd(r, 2, r.uniform(0.2, 0.35))
    step = r.standard_normal((2, 64))
    all_of += [(np.cos(t) * step[0] + np.sin(t) * step[1]).tolist() for t in np.linspace(0, 3, 30)]
    all_of += r.standard_normal((300, 64)).tolist()
    return [(int(i), v, 0) for i, v in zip(r.permutation(len(all_of)), all_of, strict=True)]


def compared(got, want):
    """No link too many, and the share of links found."""
    got = {r[0]: r for r in got}
    assert len(got) == len(want)
    assert all(got[w[0]][1] <= w[1] for w in want)
    return sum(g[1] for g in got.values()) / sum(w[1] for w in want)


def test_crowds(spark):
    rows = crowded()
    found = [tuple(r) for r in nn_descent.near_duplicates(frame(spark, rows)).collect()]
    assert compared(found, brute_links(rows)) >= 0.99
    assert len({r[2] for r in found}) == sum(r[3] for r in found)


@pytest.mark.parametrize("bucket, summaries", [(32, 16_384), (16, 7)])
def test_components_in_many_buckets(spark, monkeypatch, bucket, summaries):
    monkeypatch.setattr(nn_descent, "BUCKET", bucket)
    monkeypatch.setattr(nn_descent, "SUMMARIES", summaries)
    rows = crowded(1, 300)
    assert compared([tuple(r) for r in nn_descent.near_duplicates(frame(spark, rows)).collect()], brute_links(rows)) >= 0.99


def test_descent_finds_what_windows_miss(spark, monkeypatch):
    """With windows of a single rotation, later rounds have to find the rest."""
    monkeypatch.setattr(nn_descent, "TABLES", 1)
    monkeypatch.setattr(nn_descent, "WINDOW", 8)
    recalls, real = [], nn_descent.audited
    monkeypatch.setattr(nn_descent, "audited", lambda *a: (recalls.append(real(*a)), recalls[-1])[1])
    rows = crowded(2, 200)
    assert compared([tuple(r) for r in nn_descent.near_duplicates(frame(spark, rows)).collect()], brute_links(rows)) >= 0.9
    assert recalls[0] < recalls[-1]


def test_saturated_lists_grow(spark):
    lists = spark.createDataFrame([(1, k, 0.95) for k in range(10, 18)] + [(2, k, 0.95 - 0.02 * (k - 10)) for k in range(10, 18)] + [(3, 4, 0.99)], "u long, v long, s double")
    room = spark.createDataFrame([(k, 8) for k in (1, 2, 3, 4)], "class long, k int")
    got = {r[0]: (r[1], r[2]) for r in nn_descent.roomier(lists, room, 0.9).collect()}
    assert got[1] == (16, 0.5) and got[2][0] == 8 and abs(got[2][1] - 0.81) < 1e-9 and got[3] == got[4] == (8, 0.5)


def test_links_of_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + [(None, odd_rows()[231][1], 0), (None, [9.0, 1.0], 0), (None, [9.0, 1.0], 0), (None, [1.0, -9.0], 0)]
    got = sorted((tuple(r) for r in nn_descent.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == brute_links(rows)


def test_large_and_small_components_of_vectors(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0), (3, [1e300, -1e300], 0), (4, [5e-324, 0.0], 0)]
    got = sorted(tuple(r) for r in nn_descent.near_duplicates(frame(spark, rows, "double")).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


# --- all three --------------------------------------------------------------------------


@pytest.mark.parametrize("run", [hard_negatives.hard_negatives, drake_kmeans.clusters, nn_descent.near_duplicates])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).collect() == []
    none = run(frame(spark, [(1, None, 1), (2, [NAN] * 64, None)])).collect()
    assert none == [] or sorted(tuple(r) for r in none) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_near_vectors", "op13_centroids"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, name, sf):
    got = QUERIES[name](spark, f"/root/testdata/{sf}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = con.execute(ORACLE_SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_h"), reason="needs the table with large groups")
def test_recall_with_large_groups(spark):
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet("/root/testdata/check_h/embeddings.parquet").collect()]
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = {rows[k][0]: int((x[k] @ x.T >= 0.9).sum()) - 1 for k in range(len(rows))}
    got = {r.vec_id: r.n_links for r in QUERIES["op12_near_vectors"](spark, "/root/testdata/check_h").collect()}
    assert all(got[i] <= true[i] for i in true) and sum(got.values()) >= 0.99 * sum(true.values())


def test_products_are_exact():
    r = np.random.default_rng(0)
    a, b = (r.integers(-(2**28), 2**28, (5, 6)).astype(float) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert vectors.products(a, b).tolist() == want
