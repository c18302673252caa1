"""Centroid clustering of whole-number vectors with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and written beside it. In each
round the centroids' distances to the same pivots bound every vector-centroid distance from below
(triangle inequality); only centroids whose bound does not exceed the best exact distance so far get
an exact whole-number distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

CLUSTERS, ROUNDS, DIM, PIVOTS = 16, 3, 64, 5
SCALE = 64
LARGEST = 1 << 26  # components above would let a squared distance of 64 components leave 64 bits
SLACK = 1e-9       # share of a bound given away, far above the rounding of square roots and differences
BLOCK = 8192


def usable_vector(vector: Column, dim: int = DIM) -> Column:
    """Exactly ``dim`` components, none null, non-finite or beyond LARGEST after scaling."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST // SCALE)))
    return F.coalesce((F.size(vector) == dim) & good, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def _squares(vectors: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = vectors - center
    return np.einsum("ij,ij->i", gap, gap)


def choose_pivots(centers: np.ndarray, count: int) -> np.ndarray:
    """Pivots among the starting centroids, each the one farthest from those before it."""
    chosen = [0]
    near = _squares(centers, centers[0])
    while len(chosen) < min(count, len(centers)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _squares(centers, centers[chosen[-1]]))
    return centers[chosen]


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centers: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number), exact squared distance, and how many exact distances were computed."""
    known = np.sqrt(np.stack([_squares(centers, p) for p in pivots], 1))
    bound = np.zeros((len(vectors), len(centers)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - known[None, :, p]) - SLACK * (to_pivots[:, p, None] + known[None, :, p]), out=bound)
    bound = np.where(bound > 0, bound, 0.0) ** 2
    first = bound.argmin(1)
    best = np.einsum("ij,ij->i", vectors - centers[first], vectors - centers[first])
    where, exact = first.copy(), len(vectors)
    for c, center in enumerate(centers):
        open_ = np.flatnonzero((bound[:, c] <= best) & (first != c))
        exact += len(open_)
        d = _squares(vectors[open_], center)
        better = (d < best[open_]) | ((d == best[open_]) & (c < where[open_]))
        best[open_[better]] = d[better]
        where[open_[better]] = c
    return where, best, exact


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            roots = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield part.column(0), _matrix(part.column(1), dim), roots


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
                    dim: int = DIM, scale: int = SCALE, pivots: int = PIVOTS, seed: int = 1) -> tuple[DataFrame, list[dict]]:
    """Vectors with their cluster and squared distance, and the final centroids.

    A vector is kept if it has exactly ``dim`` components, none null or non-finite and none that
    leaves 2**26 in size when scaled (exact 64-bit distances); the others have no row. A component x
    becomes floor(scale * x). Centroids start as the ``clusters`` kept vectors with the smallest
    sha256 of ``seed:id`` (a null id counts as empty text; rows with one id go by their components),
    all of them if there are fewer. Each round replaces every non-empty centroid by the exact floor of
    its vectors' mean; empty ones stay. Repeated rows are rows of their own. An empty table, or one
    without kept vectors, gives no rows and no centroids. Other columns are not read.

    Returns (id, cluster int, distance long) and one dict per centroid: cluster, components, count, inertia.
    Only ``clusters`` rows of sums and the starting vectors reach the driver; a round reads the
    written pivot table once and shuffles one row per task and cluster.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("vector")).where(usable_vector(F.col("vector"), dim))
    codes = rows.select("id", F.transform("vector", lambda x: F.floor(x * scale).cast("int")).alias("codes"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = codes.select(key.alias("key"), "codes").orderBy("key", "codes").limit(clusters).collect()
    id_type = codes.schema["id"].dataType.simpleString()
    if not start:
        return codes.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).withColumnRenamed("id", id_col), []
    centers = np.array([r["codes"] for r in start], np.int64)
    fixed = choose_pivots(centers, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), dim)
            roots = np.sqrt(np.stack([_squares(vectors, p) for p in fixed], 1))
            steps = pa.array(np.arange(len(vectors) + 1) * len(fixed), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(steps, pa.array(roots.ravel()))], names=["id", "codes", "roots"])

    table = materialize(codes.mapInArrow(measure, f"id {id_type}, codes array<int>, roots array<double>"), "pivot-table")

    def sums(centers: np.ndarray) -> list[dict]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centers), dim + 2), np.int64)  # components, then count and inertia
            for _, vectors, roots in _blocks(batches, dim):
                where, best, _ = nearest(vectors, roots, centers, fixed)
                order = np.argsort(where, kind="stable")
                found, at = np.unique(where[order], return_index=True)
                full = np.concatenate([vectors, np.ones((len(vectors), 1), np.int64), best[:, None]], 1)
                total[found] += np.add.reduceat(full[order], at, axis=0)
            some = np.flatnonzero(total[:, dim])
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "sums": pa.array(list(total[some]), pa.list_(pa.int64()))})

        parts = table.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "part"))
        out = [[0] * (dim + 2) for _ in centers]
        for r in parts.groupBy("cluster", "i").agg(F.sum("part").alias("total")).collect():
            out[r["cluster"]][r["i"]] = r["total"]
        return [{"total": s[:dim], "count": s[dim], "inertia": s[dim + 1]} for s in out]

    for _ in range(rounds):
        centers = np.array([[t // s["count"] for t in s["total"]] if s["count"] else old.tolist() for s, old in zip(sums(centers), centers)], np.int64)
    last = centers

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, roots in _blocks(batches, dim):
            where, best, _ = nearest(vectors, roots, last, fixed)
            yield pa.RecordBatch.from_arrays([ids, pa.array(where, pa.int32()), pa.array(best)], names=["id", "cluster", "distance"])

    found = [{"cluster": c, "components": last[c].tolist(), "count": s["count"], "inertia": s["inertia"]} for c, s in enumerate(sums(last))]
    return table.mapInArrow(assign, f"id {id_type}, cluster int, distance long").withColumnRenamed("id", id_col), found


def centroid_digest(components: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
