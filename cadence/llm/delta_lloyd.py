"""Centroid clustering by delta Lloyd: assignments and sums are kept, and a round touches only what its last one changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.shared import discard, keep
from cadence.llm.vectors import finite, matrix

#: Scaled components beyond this raise: up to it, squared distances of 1,024 components fit in a long.
LARGEST = 1 << 25
#: Up to this, distances are whole numbers below 2 ** 53 in double precision, and a matrix product gives them.
EXACT = 1 << 20


def scaled_vectors(df: DataFrame, components: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows with exactly so many finite components, each as the integer floor(scale * x), x as double."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(F.coalesce(F.size("v") == components, F.lit(False)) & finite(F.col("v")))
    whole = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.abs(x.cast("double") * scale) < LARGEST
    return rows.select("vec_id", F.transform("v", lambda x: F.when(fits(x), whole(x)).otherwise(F.raise_error(F.lit(f"a scaled component is not under {LARGEST}")).cast("long")).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least SHA-256 of ``<seed>:<id>``, in this order; ties go to the lesser vector, rows without id come last."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in vectors.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact: by a matrix product where doubles hold every sum, else by differences."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT and v.shape[1] <= 1024:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1) if len(centroids) else np.zeros((len(v), 0), np.int64)


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance after the centroids in ``changed`` (a mask) have moved.

    A vector whose owner stayed has its old distance and meets the changed
    centroids only; one whose owner moved meets all. Ties go to the lesser number.
    """
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        away = squared_distances(v[lost], centroids)
        owner[lost] = away.argmin(axis=1)
        distance[lost] = away.min(axis=1)
    numbers = np.flatnonzero(changed)
    if len(numbers) and not lost.all():
        away = squared_distances(v[~lost], centroids[numbers])
        best = away.argmin(axis=1)
        near, number = away[np.arange(len(best)), best], numbers[best]
        old, old_number = distance[~lost], owner[~lost]
        better = (near < old) | ((near == old) & (number < old_number))
        owner[~lost], distance[~lost] = np.where(better, number, old_number), np.where(better, near, old)
    return owner, distance


def _round(centroids: np.ndarray, changed: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            was = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            v = matrix(batch.column("v")).astype(np.int64)
            cluster, distance = reassigned(v, was, batch.column("distance").to_numpy(zero_copy_only=False), centroids, changed)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "was", "distance"])

    return run


def _transfers(state: DataFrame, components: int) -> dict[int, tuple[int, np.ndarray]]:
    """{cluster: (signed count, signed sums)} of the vectors that changed hands: off the old owner, onto the new one; partial sums first, a row for each cluster last."""
    side = lambda c, sign: F.struct(F.col(c).alias("c"), F.lit(sign).alias("sign"))
    moved = state.where("cluster <> was").select("v", F.explode(F.array(side("was", -1), side("cluster", 1))).alias("x")).where("x.c >= 0")
    found = moved.groupBy("x.c").agg(F.sum("x.sign").alias("n"), *(F.sum(F.col("v")[i].cast("long") * F.col("x.sign")).alias(f"s{i}") for i in range(components)))
    return {r.c: (r.n, np.array([r[f"s{i}"] for i in range(components)], object)) for r in found.collect()}


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: float = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector that is kept.

    Vectors of exactly ``components`` finite components become integers. Each
    round assigns every vector to its nearest centroid and moves the centroids to
    the floors of their means; after the last one vectors are assigned once more.
    State is a table of vectors with owner and distance, written anew in each
    round without a shuffle; the k sums and counts stay beside it and take only
    the signed transfers of vectors that changed hands. What the driver holds is
    k * components numbers.

    Other vectors (null, shorter, longer, with null or non-finite components)
    have no row; fewer vectors than k are as many centroids; repeated rows and
    rows without id take part like others, but centroids start without the latter
    as far as there are others; empty tables give no rows; other columns are
    ignored. Scaled components of 2 ** 25 and more raise.
    """
    vectors = scaled_vectors(df, components, scale, id_col, vector_col)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return vectors.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in none.items())).limit(0)
    counts, sums = np.zeros(len(centroids), object), np.zeros(centroids.shape, object)
    changed = np.ones(len(centroids), bool)
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(0).cast("long").alias("distance"))
    old = None
    for n in range(rounds + 1):
        if changed.any():
            state = keep(state.mapInArrow(_round(centroids, changed), state.schema), "clusters")
            if old is not None:
                discard(old)
            old = state
        if n == rounds or not changed.any():
            break
        for c, (count, total) in _transfers(state, components).items():
            counts[c] += count
            sums[c] += total
        moved = np.array([[s // m for s in row] if m else was for row, m, was in zip(sums, counts, centroids.tolist())], np.int64)
        changed = (moved != centroids).any(axis=1)
        centroids = moved
    return _with_totals(state, centroids)


def _digest(centroid: np.ndarray) -> Column:
    return F.sha2(F.lit(",".join(map(str, centroid.tolist()))), 256)


def _with_totals(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Sums of distances by cluster (a row each, k in all) and their total beside each vector."""
    own = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = own.agg(F.sum("cluster_inertia").alias("inertia"))
    digest = F.element_at(F.array(*map(_digest, centroids)), F.col("cluster") + 1)
    beside = own.join(F.broadcast(total)).select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(beside), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
