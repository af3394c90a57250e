"""Centroid clustering with adaptive distance bounds.

Every vector keeps its centroid, lower bounds of its distances to the several centroids next
to that, in their order, and one remainder bound for all others. When centroids have moved,
each bound goes down by the movement. A vector's distance to its own centroid is computed
exactly; bounds above it rule their centroids out. Those that it reaches are computed exactly
too, and if it reaches the remainder bound, no order can be certified and all centroids are
scanned anew. How many bounds are kept adapts to how many were reached in the round before.

Components are integers, and so are centroids and squared distances: exact in doubles below
2^53, in longs beyond it. Bounds are doubles, rounded to the safe side by `SLACK`, so results
are those of scanning everything, ties included.

Vectors with their bounds are a written table from round to round, which a lost executor's
tasks read again. A round is one pass over it; sums are updated by the vectors that changed
their cluster alone. The driver holds the centroids and their sums, whose number is a parameter.

Edge cases: rows whose vector is null, has another number of components, or a null or
non-finite one, are left out, as are those whose scaled squared norm is 2^60 or more, since
distances are longs. Each row is a vector, also if it repeats a vec_id. A null vec_id is
clustered but never a starting centroid. Equal hashes (repeated vec_ids) start in the order of
their components. With fewer vectors than centroids there are fewer centroids; with no vector
that has a vec_id, or an empty table, there are no rows. Sums of distances that don't fit a
long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import vectors
from foliary.llm.scratch import Scratch

SLACK = 1e-9
#: Vectors that a task handles at once.
ROWS = 8192
STATE = "vec_id long, v array<long>, was int, cluster int, distance long, near array<int>, low array<double>, rest double, reached int"


def distances(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids, as longs."""
    both = vectors.products(m, centroids).astype(np.int64)
    return square(m)[:, None] - 2 * both + square(centroids)[None]


def square(m: np.ndarray) -> np.ndarray:
    if not len(m):
        return np.zeros(0, dtype=np.int64)
    if (m * m).sum(axis=1).max() < 2.0**53:
        return (m * m).sum(axis=1).astype(np.int64)
    return (m.astype(np.int64) ** 2).sum(axis=1)


def to_some(m: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to one centroid of its own."""
    return square(m - centroids[which])


class Scan:
    """The state of some vectors after all centroids have been computed."""

    def __init__(self, m: np.ndarray, centroids: np.ndarray, keep: int):
        d = distances(m, centroids)
        order = np.lexsort((np.broadcast_to(np.arange(len(centroids)), d.shape), d), axis=1)
        sorted_d = np.take_along_axis(d, order, axis=1)
        roots = np.sqrt(sorted_d.astype(np.float64)) * (1 - SLACK)
        self.cluster, self.distance = order[:, 0], sorted_d[:, 0]
        self.near, self.low = order[:, 1 : keep + 1], roots[:, 1 : keep + 1]
        self.rest = roots[:, keep + 1] if keep + 1 < len(centroids) else np.full(len(m), np.inf)


def moved_on(m: np.ndarray, state: dict[str, np.ndarray], centroids: np.ndarray, moves: np.ndarray, keep: int) -> dict[str, np.ndarray]:
    """The state after the centroids have moved to `centroids`, by `moves`."""
    n, rows = len(m), np.arange(len(m))
    was, near = state["cluster"], state["near"]
    low = state["low"] - moves[near] * (1 + SLACK)
    rest = state["rest"] - moves.max() * (1 + SLACK)
    own = to_some(m, centroids, was)
    reach = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    # Bounds that the vector's own distance reaches are replaced by what they bound.
    reached = low <= reach[:, None]
    r, c = np.nonzero(reached)
    exact = np.full(near.shape, np.iinfo(np.int64).max)
    exact[r, c] = to_some(m[r], centroids, near[r, c])
    low[r, c] = np.sqrt(exact[r, c].astype(np.float64)) * (1 - SLACK)
    all_d = np.concatenate([own[:, None], exact], axis=1)
    all_c = np.concatenate([was[:, None], near], axis=1)
    first = np.lexsort((all_c, all_d), axis=1)[:, 0]
    cluster, distance = all_c[rows, first], all_d[rows, first]
    # The old centroid takes the place of the one that goes up, with its exact distance.
    swap = first > 0
    near, at = near.copy(), first - 1
    near[swap, at[swap]] = was[swap]
    low[swap, at[swap]] = (np.sqrt(own.astype(np.float64)) * (1 - SLACK))[swap]
    order = np.argsort(low, axis=1, kind="stable")
    near, low = np.take_along_axis(near, order, axis=1), np.take_along_axis(low, order, axis=1)
    if keep < near.shape[1]:
        rest = np.minimum(rest, low[:, keep])
        near, low = near[:, :keep], low[:, :keep]
    depth = reached.sum(axis=1)
    # Nothing certifies the others where the remainder bound is reached, before any is dropped.
    open_ = state["rest"] - moves.max() * (1 + SLACK) <= np.sqrt(distance.astype(np.float64)) * (1 + SLACK)
    if open_.any():
        scan = Scan(m[open_], centroids, near.shape[1])
        cluster[open_], distance[open_], near[open_], low[open_], rest[open_] = scan.cluster, scan.distance, scan.near, scan.low, scan.rest
        depth[open_] = near.shape[1]
    return {"was": was, "cluster": cluster, "distance": distance, "near": near, "low": low, "rest": rest, "reached": np.minimum(depth, n and near.shape[1])}


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = np.ascontiguousarray(m).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(flat).cast(kind))


def batch_of(ids: pa.Array, m: np.ndarray, state: dict[str, np.ndarray]) -> pa.RecordBatch:
    was = pa.array(state["was"], pa.int32()) if state["was"] is not None else pa.nulls(len(m), pa.int32())
    columns = [ids, lists(m.astype(np.int64), pa.int64()), was, pa.array(state["cluster"], pa.int32()), pa.array(state["distance"], pa.int64())]
    columns += [lists(state["near"], pa.int32()), lists(state["low"], pa.float64()), pa.array(state["rest"], pa.float64()), pa.array(state["reached"], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "was", "cluster", "distance", "near", "low", "rest", "reached"])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def first_pass(centroids: np.ndarray, keep: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for rows, m in vectors.scaled(batch.column("embedding")):
                scan = Scan(m, centroids, keep)
                state = {"was": None, "cluster": scan.cluster, "distance": scan.distance, "near": scan.near, "low": scan.low, "rest": scan.rest, "reached": np.full(len(m), keep)}
                yield batch_of(batch.column("vec_id").take(pa.array(rows)), m, state)

    return look


def next_pass(centroids: np.ndarray, moves: np.ndarray, keep: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = batch.num_rows
            if not n:
                continue
            table = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)  # noqa: B023, E731
            state = {name: batch.column(name).to_numpy() for name in ("cluster", "rest")} | {"near": table("near"), "low": table("low")}
            m = table("v").astype(np.float64)
            yield batch_of(batch.column("vec_id"), m, moved_on(m, state, centroids, moves, keep))

    return look


def changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster add to the sums and counts of all clusters."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            m = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            for name, sign in (("cluster", 1), ("was", -1)):
                known = batch.column(name).is_valid().to_numpy(zero_copy_only=False)
                which = batch.column(name).drop_null().to_numpy()
                np.add.at(sums, which, sign * m[known])
                np.add.at(counts, which, sign)
        used = np.flatnonzero(counts | sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), lists(sums[used], pa.int64())], names=["cluster", "n", "s"])

    rows = state.where("was is null or was <> cluster").select("v", "was", "cluster").mapInArrow(add, "cluster int, n long, s array<long>")
    total = rows.select("cluster", "n", F.posexplode("s").alias("p", "x")).groupBy("cluster", "p").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
    at = total["cluster"].to_numpy()
    sums[at, total["p"].to_numpy()] = total["x"].to_numpy()
    counts[at] = total["n"].to_numpy()
    return sums, counts


def starting(vecs: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose '<seed>:<vec_id>' has the smallest hash."""
    known = vecs.where(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "embedding")
    found = known.orderBy("h", "embedding").limit(k).select("embedding").toArrow()["embedding"].combine_chunks()
    parts = vectors.scaled(found)
    return parts[0][1] if parts else np.zeros((0, 1))


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "kmeans")
    vecs = embeddings.where(vectors.whole(F.col("embedding")) & (F.size("embedding") == dim)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # Squared norms of 2^60 and more don't fit; a margin for rounding keeps both filters alike.
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1e15)), F.lit(1e15)) * 256).cast("double"), F.lit(2.0)))
    vecs = vecs.where(norm2 < vectors.LARGEST_NORM2)
    centroids = starting(vecs, k, seed)
    k = len(centroids)
    keep = min(max(1, k // 4), k - 1) if k else 0
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = scratch.save(vecs.mapInArrow(first_pass(centroids, keep), STATE), "state-0")
    sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
    for r in range(1, rounds + 1):
        more, n = changes(state, k, dim)
        sums, counts = sums + more, counts + n
        new = centroids.copy()
        used = counts > 0
        new[used] = sums[used] // counts[used][:, None]  # exact, rounds down
        moves = np.sqrt(square(new - centroids).astype(np.float64))
        centroids = new
        keep = min(keep, max(1, k // 8, state.agg(F.max("reached")).first()[0] or 0))
        state = scratch.save(state.mapInArrow(next_pass(centroids, moves, keep), STATE), f"state-{r}")
        scratch.drop(f"state-{r - 1}")
    names = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    per = state.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).toArrow()
    own = dict(zip(per["cluster"].to_pylist(), per["cluster_inertia"].to_pylist(), strict=True))
    total = None if None in own.values() or sum(own.values()) >= 1 << 63 else sum(own.values())
    table = spark.createDataFrame([(c, own[c], total, names[c]) for c in own], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> str:
    """Every vector against every centroid, round by round."""
    with_ = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        with_.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, cluster, c, CAST(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS BIGINT) AS distance FROM v, c{r}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            with_.append(f"""s{r} AS (SELECT cluster, p, floor(sum(x) / count(*)) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{r}) GROUP BY cluster, p)""")
            with_.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT cluster, list(m ORDER BY p) AS c FROM s{r} GROUP BY cluster) n USING (cluster))")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(with_) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM {last}
"""  # fmt: skip
