"""Centroid clustering with Hamerly's bounds, exact in whole numbers.

Every vector carries its cluster, an upper bound of the distance to its centroid and one lower bound of the distance to
the second nearest. When centroids move, the bounds are loosened by the drift; a vector whose bounds still part is not
measured, one whose bounds meet has its upper bound made exact, and only if they still meet it is measured against all
centroids in whole numbers. The state is a table of the shared folder, a new one each round; sums of a cluster are
aggregated by Spark and k rows of them reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import released, written
from loomtext.llm.vectors import finite, floor_means, matrix, whole

STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long, measured int"


def _above(x: np.ndarray) -> np.ndarray:
    """Not below the real number that x, a rounded one, stands for."""
    return x * (1 + 1e-12) + 1e-9


def _below(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-12) - 1e-9


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    return (v * v).sum(axis=1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(axis=1)[None]


def own_squared(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    diff = v - centroids[cluster]
    return (diff * diff).sum(axis=1)


def moved_bounds(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold after each centroid moved by up to its drift: the own one for upper, the most of the others for lower."""
    order = np.argsort(drift)
    most = int(order[-1])
    second = drift[order[-2]] if len(drift) > 1 else 0.0
    return _above(upper + drift[cluster]), _below(lower - np.where(cluster == most, second, drift[most]))


def assign(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Bring cluster, upper and lower up to date in place; which rows were measured against all centroids."""
    between = squared(centroids, centroids).astype(float)
    np.fill_diagonal(between, np.inf)
    half = _below(np.sqrt(between.min(axis=1)) / 2)  # who is nearer than this has no nearer centroid
    least = np.maximum(half[cluster], lower)
    close = np.flatnonzero(upper >= least)
    upper[close] = _above(np.sqrt(own_squared(v[close], centroids, cluster[close]).astype(float)))
    unsure = close[upper[close] >= least[close]]
    if len(unsure):
        d = squared(v[unsure], centroids)
        cluster[unsure] = best = d.argmin(axis=1)  # the first of equal ones
        here = np.arange(len(unsure))
        upper[unsure] = _above(np.sqrt(d[here, best].astype(float)))
        other = d.astype(float)
        other[here, best] = np.inf
        lower[unsure] = _below(np.sqrt(other.min(axis=1)))
    return unsure


def _round(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """State after one more assignment; without drift, rows (vec_id, v) that have none yet."""
    dims = centroids.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = matrix(batch.column("v"), dims)
            if drift is None:
                cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)
            else:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                upper, lower = moved_bounds(cluster, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), drift)
            measured = np.zeros(n, np.int32)
            measured[assign(v, centroids, cluster, upper, lower)] = 1
            distance = own_squared(v, centroids, cluster)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance), pa.array(measured)], [x.split()[0] for x in STATE.split(", ")])

    return state.mapInArrow(step, STATE)


def seeds(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the least sha256 of `seed:vec_id`, a null id as an empty one; equal ids in order of their vectors."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in vectors.select("v", hashed.alias("h")).orderBy("h", "v").limit(k).collect()]


def clustered(rows: DataFrame, dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, trace: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and measured, a row for each kept vector.

    Kept are vectors of exactly `dims` components, all of them there and finite. With fewer kept vectors than k there are
    as many centroids; without any there are no rows. Repeated rows and ids each count and give a row; equally near
    centroids give the smaller number; a centroid without vectors stays. Other columns than vec_id and embedding
    are not looked at. measured: whether the last assignment had to look at all centroids. trace gets, for each
    assignment, how many vectors were measured against all.
    """
    spark = rows.sparkSession
    kept = written(whole(rows, scale, finite(F.col("embedding")) & (F.size("embedding") == dims)).withColumn("vec_id", F.col("vec_id").cast("long")), "vectors")
    start = seeds(kept, k, seed)
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured int")
    centroids = np.array(start, np.int64)
    state = written(_round(kept, centroids, None), "hamerly")
    released(kept)
    for _ in range(rounds):
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("measured").alias("m"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dims)]).alias("sums")).collect()
        moved = centroids.copy()
        for r in sums:
            moved[r["cluster"]] = floor_means(r["sums"], r["n"])
        if trace is not None:
            trace.append(sum(r["m"] for r in sums))
        drift = _above(np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(float)))
        centroids, before = moved, state
        state = written(_round(before, centroids, drift), "hamerly")
        released(before)
    told = state.groupBy("cluster").agg(F.sum("distance").alias("inertia"), F.sum("measured").alias("m")).collect()
    if trace is not None:
        trace.append(sum(r["m"] for r in told))
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest()
    per = spark.createDataFrame([(r["cluster"], r["inertia"], sum(x["inertia"] for x in told), digest(r["cluster"])) for r in told], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")


def oracle(dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """The same rows in SQL, every vector measured against every centroid in every round."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS i, unnest(v) AS x FROM kept)",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN parts USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT vec_id, c, sum((p.x - c.x) * (p.x - c.x)) AS d FROM parts p JOIN c{r} c USING (i) GROUP BY ALL)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"m{r} AS MATERIALIZED (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM a{r} JOIN parts USING (vec_id) GROUP BY ALL)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c, i))")
    return f"""WITH {', '.join(parts)}, h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"""
