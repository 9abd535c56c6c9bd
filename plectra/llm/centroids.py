"""Centroid clustering by annulus search over exact integers.

Vectors are turned into integers and assigned to the nearest of ``k`` centroids in rounds.  A task sorts the centroids by
norm.  For each vector it takes the nearest of the few centroids (about the root of ``k``) whose norms stand beside the vector's own; that
distance bounds the nearest one of all, so only centroids whose norms differ from the vector's by no more can be as near.  Two binary
searches find them, and their distances are compared as integers, ties included.  A round leaves a count and componentwise
sums a cluster and task; Spark adds these up, and at most ``k * dims`` sums reach the driver.

Defined results: a vector of another length, or with a null or non-finite component, is left out, as is a null vector;
null ids and repeated rows are kept and count each; fewer vectors than ``k`` give as many centroids; an empty table
gives no rows; other columns are left out.  Components beyond 2**27 after scaling are held there, as a squared distance
must fit 64 bits; sums beyond 64 bits are held at the largest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import table, write_table

CENTROIDS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED = 2
ROWS = 4096
LARGEST = 2**27
LONGEST = 2**63 - 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, embedding) of the vectors with ``dims`` finite components."""
    narrow = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return narrow.where((F.size("embedding") == dims) & finite)


def scaled(values: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Integer rows of a list column."""
    flat = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


class Annuli:
    """Centroids in order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.sorted = centroids[self.order]
        self.probes = math.isqrt(len(centroids)) + 1

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of places in norm order that may hold a vector's nearest centroid."""
        own = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        k = len(self.norms)
        first = np.searchsorted(self.norms, own) - self.probes // 2
        bound = np.full(len(x), LONGEST, np.int64)
        for step in range(self.probes):
            bound = np.minimum(bound, squared(x, self.sorted[np.clip(first + step, 0, k - 1)]))
        # A hair wider than the bound, for the rounding of norms and roots.
        reach = np.sqrt(bound.astype(float)) + 1e-9 * (own + self.norms[-1] + 1)
        return np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row; the smaller number wins a tie."""
        number = np.full(len(x), len(self.order), np.int64)
        best = np.full(len(x), LONGEST, np.int64)
        low, high = self.candidates(x)
        for place in range(int(low.min(initial=0)), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= place) & (place < high))
            away = squared(x[rows], self.sorted[place])
            name = self.order[place]
            better = (away < best[rows]) | ((away == best[rows]) & (name < number[rows]))
            rows = rows[better]
            best[rows], number[rows] = away[better], name
        return number, best


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


def means(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The centroids after a round: the floor of each cluster's exact mean; an empty cluster keeps its centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, counts, sums = Annuli(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for part in (b for batch in batches for b in blocks(batch)):
            x = scaled(part.column(0), dims, scale)
            number, _ = annuli.nearest(x)
            order = np.argsort(number, kind="stable")
            names, first = np.unique(number[order], return_index=True)
            if len(names):
                sums[names] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(number, minlength=k)
        held = np.flatnonzero(counts)
        arrays = [pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "n", "sums"])

    parts = vectors.select("embedding").mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = "decimal(38,0)"
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("place", "value")).groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("value").cast(wide)).alias("value")
    )
    moved = centroids.copy()
    for row in totals.collect():  # at most k * dims rows
        moved[row.cluster, row.place] = int(row.value) // row.n
    return moved


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for part in (b for batch in batches for b in blocks(batch)):
            number, best = annuli.nearest(scaled(part.column(1), dims, scale))
            arrays = [part.column(0), pa.array(number, pa.int32()), pa.array(best, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED, scale: int = SCALE) -> np.ndarray:
    """The ``k`` vectors of the least hashes of their ids, in that order; of equal hashes the lesser vector comes first."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(named.cast("binary"), 256).alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    if not rows:
        return np.zeros((0, 0), np.int64)
    return scaled(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), len(rows[0].embedding), scale)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """One row a kept vector: its cluster, squared distance, the inertia of its cluster and of all, its centroid's digest."""
    spark = vectors.sparkSession
    kept = usable(vectors, dims)
    centroids = first_centroids(kept, k, seed, scale)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = means(kept, centroids, scale)
    placed = write_table(assign(kept, centroids, scale), "assigned")
    inertia = {r.cluster: int(r.inertia) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    total = min(sum(inertia.values()), LONGEST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(c, min(held, LONGEST), total, digest[c]) for c, held in inertia.items()]  # at most k rows
    names = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rows by comparing every vector with every centroid."""
    parts = [
        "WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v "
        f"FROM embeddings WHERE len(embedding) = {DIMS} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        f"places AS (SELECT unnest(range(1, {DIMS + 1})) AS pos)",
        "longs AS MATERIALIZED (SELECT vec_id, pos, v[pos] AS x FROM kept, places)",
        "firsts AS (SELECT v, row_number() OVER (ORDER BY h) - 1 AS c FROM "
        f"(SELECT v, sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h LIMIT {CENTROIDS}))",
        "c0 AS MATERIALIZED (SELECT c, pos, v[pos] AS x FROM firsts, places)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"d{r} AS (SELECT vec_id, c, sum((l.x - k.x) * (l.x - k.x)) AS d FROM longs l JOIN c{r} k USING (pos) GROUP BY vec_id, c), "
            f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"
        )
        if r < ROUNDS:
            parts.append(
                f"s{r} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM longs JOIN a{r} USING (vec_id) GROUP BY c, pos), "
                f"c{r + 1} AS MATERIALIZED (SELECT c, pos, CAST(coalesce((s - ((s % n) + n) % n) // n, x) AS BIGINT) AS x FROM c{r} LEFT JOIN s{r} USING (c, pos))"
            )
    return ", ".join(parts) + (
        f", digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c) "
        "SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN digests USING (c)"
    )


OP11_SQL = _sql()
