"""Clustering around centroids by equal-average equal-variance nearest neighbour search, in exact integers.

Components become integers floor(scale * x).  With s the sum, u the distance of a vector from its own mean, d the
number of components, two vectors x and c are at least as far apart as their means and their deviations allow:

    |x - c|^2 >= (s_x - s_c)^2 / d            (equal average)
    |x - c|^2 >= (s_x - s_c)^2 / d + (u_x - u_c)^2      (equal variance)

Centroids lie in the order of their means.  Each vector looks at them outward from its own mean: once the nearer
side fails the first bound all others fail it too; a centroid that fails the second is passed over; the rest is
measured in 64-bit integers.  The bounds are floats with a margin, so they never reject a tie or a nearer centroid.

A round sends the centroids to the tasks and gets back one row for each task, cluster and component; Spark adds
these up, and k * d sums come to the driver.  Vectors are never shuffled, so no cluster can be too large.

Defined results: vectors that are null, of another length, or with null or non-finite components are left out;
components beyond 2^27 in size (that is 131072 at scale 1024) count as 2^27, so that distances fit in 64 bits;
vectors without id never start a centroid but are assigned; with fewer vectors than k there are as many centroids
as vectors; repeated rows are vectors of their own; a sum of distances beyond 64 bits is null; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.common import kept

DIMS = 64
SCALE = 1024
MOST = 1 << 27
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Vectors that are searched together inside a task.
BLOCK = 1 << 14


def search(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector; of equally near ones the least number."""
    n, dims = vectors.shape
    order = np.argsort(centroids.sum(axis=1), kind="stable")
    ranked = centroids[order]
    c_sum, c_size, c_dev = _shape(ranked)
    v_sum, v_size, v_dev = _shape(vectors)
    right = np.searchsorted(c_sum, v_sum)
    left = right - 1
    best = np.full(n, np.iinfo(np.int64).max)
    who = np.full(n, len(centroids))
    active = np.arange(n)
    while len(active):
        lo, hi = left[active], right[active]
        below = np.where(lo >= 0, v_sum[active] - c_sum[lo], np.inf)
        above = np.where(hi < len(ranked), c_sum[np.minimum(hi, len(ranked) - 1)] - v_sum[active], np.inf)
        up = above < below
        gap = np.minimum(below, above)
        at = np.where(up, hi, lo)
        right[active] += up
        left[active] -= ~up
        limit = best[active] * (1 + 1e-9) + 1e-3
        mean_bound = gap * gap / dims
        going = mean_bound <= limit  # the sides move away from the mean, so what fails now fails for good
        active, at, mean_bound, limit = active[going], at[going], mean_bound[going], limit[going]
        apart = np.maximum(np.abs(v_dev[active] - c_dev[at]) - 1e-6 * (v_size[active] + c_size[at]), 0)
        near = mean_bound + apart * apart <= limit
        rows, place = active[near], at[near]
        diff = vectors[rows] - ranked[place]
        exact = np.einsum("ij,ij->i", diff, diff)
        number = order[place]
        better = (exact < best[rows]) | ((exact == best[rows]) & (number < who[rows]))
        best[rows[better]] = exact[better]
        who[rows[better]] = number[better]
    return who, best


def _shape(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, length and distance from the own mean of each row, as floats."""
    total = x.sum(axis=1).astype(np.float64)
    square = np.einsum("ij,ij->i", x, x).astype(np.float64)
    return total, np.sqrt(square), np.sqrt(np.maximum(square - total * total / x.shape[1], 0))


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of 32-bit integers as one binary value each."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * (4 * values.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dims).astype(np.int64)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, v`` of the vectors that count; ``v`` holds the components as little-endian 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(scale * x), -MOST, MOST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(whole)], ["vec_id", "v"])

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where((F.size("x") == dims) & finite)
    return rows.mapInArrow(work, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v binary")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            vectors = _integers(part.column(1), centroids.shape[1])
            yield part, vectors, *search(vectors, centroids)


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each component of their vectors; empty ones stay."""
    k, dims = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, vectors, who, _ in _assigned(batches, centroids):
            for c in np.unique(who):
                own = who == c
                sums[c] += vectors[own].sum(axis=0)
                counts[c] += own.sum()
        place = np.arange(k * dims)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place // dims, place % dims, sums.ravel(), np.repeat(counts, dims))], ["c", "i", "s", "n"])

    parts = packed.mapInArrow(work, "c long, i long, s long, n long")
    total = parts.groupBy("c", "i").agg(*[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("s", "n")])
    new = centroids.copy()
    for row in total.collect():  # k * dims rows
        if row.n:
            new[row.c, row.i] = int(row.s) // int(row.n)
    return new


def first_centroids(packed: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = packed.where("vec_id IS NOT NULL").select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.v), dtype="<i4") for r in rows], dtype=np.int64).reshape(-1, dims)


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector, and the final centroids as a k x dims array."""
    packed = kept(integer_vectors(vectors, id_col, vec_col, dims, scale))
    centroids = first_centroids(packed, k, seed, dims)
    kind = packed.schema["vec_id"].dataType.simpleString()
    if not len(centroids):  # no vector has an id, so there is nothing to be assigned to
        return packed.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        new = moved(packed, centroids)
        if (new == centroids).all():
            break  # later rounds would change nothing
        centroids = new

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, who, distance in _assigned(batches, centroids):
            arrays = [part.column(0), pa.array(who, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance"])

    return packed.mapInArrow(work, f"vec_id {kind}, cluster int, distance long"), centroids


def cluster_digest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    assigned, centroids = cluster_vectors(vectors, id_col, vec_col, **options)
    assigned = kept(assigned)
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    hashes = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = sums.agg(F.sum("own").alias("all"))
    # One row per centroid.
    clusters = sums.join(hashes, "cluster").crossJoin(total).selectExpr(
        "cluster", "try_cast(own AS bigint) AS cluster_inertia", "try_cast(all AS bigint) AS inertia", "centroid_sha256"
    )
    joined = assigned.join(F.broadcast(clusters), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _cluster_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """The same rounds written out in SQL, all vectors against all centroids."""
    square = f"list_sum([(v[i] - c.c[i])::HUGEINT * (v[i] - c.c[i]) FOR i IN range(1, {dims + 1})])"
    ctes = [
        f"""x AS MATERIALIZED (
  SELECT vec_id, [floor({SCALE} * e::DOUBLE)::BIGINT FOR e IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, v AS c FROM x ORDER BY sha256('{SEED}:' || vec_id) LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, min({square} * {k} + k) AS best FROM x CROSS JOIN c{r} c GROUP BY vec_id, v)")
        if r < rounds:
            ctes.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT o.k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT best % {k} AS k, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, {dims + 1}) AS t(i) GROUP BY 1, 2)
    GROUP BY k) n ON n.k = o.k)"""
            )
    return f"""WITH {', '.join(ctes)}
SELECT vec_id, (best % {k})::INT AS cluster, (best // {k})::BIGINT AS distance,
  sum(best // {k}) OVER (PARTITION BY best % {k})::BIGINT AS cluster_inertia, sum(best // {k}) OVER ()::BIGINT AS inertia,
  sha256(array_to_string([e::VARCHAR FOR e IN c.c], ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.k = best % {k}"""


#: The rows of the query in SQL.
CLUSTER_SQL = _cluster_sql()
