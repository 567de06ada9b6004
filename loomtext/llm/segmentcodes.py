"""Vector codes: each part of a vector as the number of its nearest codebook entry, found through segment-mean lower bounds.

A part and an entry are compared from coarse to fine. On each level the part falls into 1, 2, 4, ... segments; the squared
distance is at least the sum over segments of (difference of sums)**2 / length, plus the square of the difference
of the norms of what the means leave over. Entries whose bound is over a distance already measured are out;
what is left is measured in whole numbers. Codebooks are refined by rounds of one pass each: tasks add up their parts by
entry, Spark adds up the tasks' sums, and parts x entries rows of them reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import written
from loomtext.llm.vectors import finite, floor_means, matrix, whole


class Codebook:
    """Entries (n, width) of one part with their segment sums and residual norms on each level."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        width = entries.shape[1]
        self.levels = []
        pieces = 1
        while True:
            cuts = np.unique(np.linspace(0, width, pieces + 1).astype(int))[:-1]
            self.levels.append((cuts, np.diff(np.append(cuts, width)).astype(float), *self._profile(entries, cuts)))
            pieces *= 2
            if pieces > width // 2:
                break

    @staticmethod
    def _profile(x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the segments, and the norm of what their means leave over."""
        sums = np.add.reduceat(x, cuts, axis=1).astype(float)
        lengths = np.diff(np.append(cuts, x.shape[1]))
        left = (x * x).sum(axis=1).astype(float) - (sums * sums / lengths).sum(axis=1)
        return sums, np.sqrt(np.maximum(left, 0.0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of x its nearest entry (of equal ones the first) and the squared distance; and how many were measured."""
        n, k = len(x), len(self.entries)
        if not n or not x.shape[1]:
            return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        size = (x * x).sum(axis=1).astype(float) + (self.entries * self.entries).sum(axis=1).max()
        slack = 1e-9 * size + 1e-6  # more than rounding can do to a bound

        def bounds(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            cuts, lengths, sums, rest = self.levels[level]
            own, left = self._profile(x, cuts)
            diff = own[i] - sums[j]
            return (diff * diff / lengths).sum(axis=1) + (left[i] - rest[j]) ** 2

        i, j = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
        coarse = bounds(0, i, j)
        guess = coarse.reshape(n, k).argmin(axis=1)
        most = ((x - self.entries[guess]) ** 2).sum(axis=1)
        alive = coarse - slack[i] <= most[i]
        i, j = i[alive], j[alive]
        for level in range(1, len(self.levels)):
            alive = bounds(level, i, j) - slack[i] <= most[i]
            i, j = i[alive], j[alive]
        found = np.full((n, k), np.iinfo(np.int64).max)
        diff = x[i] - self.entries[j]
        found[i, j] = (diff * diff).sum(axis=1)
        code = found.argmin(axis=1)
        return code, found[np.arange(n), code], len(i)


def _refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: each entry the floor of the mean of its parts, an unused one as it was."""
    parts, (k, width) = len(books), books[0].shape
    found = [Codebook(b) for b in books]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), parts * width)
            for p in range(parts):
                x = v[:, p * width : (p + 1) * width]
                code, _, _ = found[p].nearest(x)
                np.add.at(sums[p], code, x)
                n[p] += np.bincount(code, minlength=k)
        at = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays([pa.array((at // k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(n.ravel()[at]), pa.array(list(sums.reshape(-1, width)[at]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    told = vectors.select("v").mapInArrow(add, "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
    out = [b.copy() for b in books]
    for r in told.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")).collect():
        out[r["part"]][r["entry"]] = floor_means(r["sums"], r["n"])
    return out


def codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook for each part of vectors (vec_id, v) of one length, from those of the least vec_ids, nulls last."""
    start = np.array([r["v"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], np.int64)
    books = np.split(start, parts, axis=1)
    for _ in range(rounds):
        books = _refined(vectors, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encoded(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256 and measured, a row a vector.

    Vectors that are null or hold nulls or numbers that aren't finite are dropped. All others must have one length, a multiple of
    `parts`: that of the least vec_id which has such a length; vectors of another length have a row with code, error
    and measured null. Repeated rows and ids each count and give a row; equally near entries give the lower index; with
    fewer vectors than entries a codebook has as many. label_error adds up the error of equal labels, nulls together.
    measured: entries that needed an exact distance, of parts x entries. Other columns are not looked at.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256: a code has two hex digits")
    spark = rows.sparkSession
    kept = written(whole(rows, scale, finite(F.col("embedding")), ("label",)).withColumn("vec_id", F.col("vec_id").cast("long")), "vectors")
    first = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("dims")).limit(1).collect()
    dims = first[0]["dims"] if first else 0
    fitting = kept.where(F.size("v") == dims) if dims else kept.where("false")
    books = codebooks(fitting, parts, entries, rounds) if dims else []
    found, width = [Codebook(b) for b in books], dims // parts

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = matrix(batch.column("v"), dims), batch.num_rows
            codes, error, measured = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64), 0
            for p in range(parts):
                code, d, looked = found[p].nearest(v[:, p * width : (p + 1) * width])
                codes[:, p] = code
                error += d
                measured += looked
            text = codes.tobytes().hex()
            each = pa.array([text[2 * parts * i : 2 * parts * (i + 1)] for i in range(n)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), each, pa.array(error), pa.array(np.full(n, measured / max(n, 1)))], ["vec_id", "label", "code", "error", "measured"])

    label = kept.schema["label"].dataType.simpleString()
    coded = fitting.mapInArrow(encode, f"vec_id long, label {label}, code string, error long, measured double") if dims else spark.createDataFrame([], f"vec_id long, label {label}, code string, error long, measured double")
    other = kept.where(F.size("v") != dims).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("double").alias("measured"))
    every = written(coded.unionByName(other), "codes")
    sums = every.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    told = every.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return told.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "measured")


def oracle(dims: int = 64, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same rows in SQL for tables whose vectors have `dims` components, every entry measured."""
    width = dims // parts
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"comp AS MATERIALIZED (SELECT vec_id, g // {width} AS p, g % {width} AS i, x FROM (SELECT vec_id, unnest(range({dims})) AS g, unnest(v) AS x FROM kept))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries})",
        "c0 AS MATERIALIZED (SELECT p, e, i, x FROM first JOIN comp USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT vec_id, p, e, sum((v.x - c.x) * (v.x - c.x)) AS d FROM comp v JOIN c{r} c USING (p, i) GROUP BY ALL)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, e, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS MATERIALIZED (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM a{r} JOIN comp USING (vec_id, p) GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, i, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (p, e, i))")
    return f"""WITH {', '.join(steps)}, coded AS (SELECT vec_id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"""
