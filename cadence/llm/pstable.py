"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact distances for all candidates."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.shared import joinable, keep, partitions, returning_memory
from cadence.llm.vectors import matrix, usable

TABLES, HASHES, WIDTH, PROBES = 6, 4, 1.2, 40
#: Vectors of a bucket that are searched in one piece; larger buckets are cut.
PIECE = 4096


@cache
def probe_sets(hashes: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """Which of a query's 2 * hashes bucket borders, nearest first, to step over: the likeliest sets by the expected squared distances."""
    m, spread = hashes, 4.0 * (hashes + 1) * (hashes + 2)
    cost = [j * (j + 1) / spread for j in range(1, m + 1)]
    cost += [1 - j / (m + 1) + j * (j + 1) / spread for j in range(m, 0, -1)]
    heap, found = [(cost[0], (0,))], [()]
    while heap and len(found) < probes:
        total, over = heapq.heappop(heap)
        if not any(2 * m - 1 - x in over for x in over):  # both borders of one hash can't be stepped over
            found.append(over)
        last = over[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*over[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*over, last + 1)))
    return tuple(found)


class PStableTables:
    """Tables of ``hashes`` functions floor((a x + b) / width) with a from a normal distribution, over vectors of length 1."""

    def __init__(self, dimensions: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shape = tables, hashes
        self.lines = rng.normal(size=(dimensions, tables * hashes)) / width
        self.shift = rng.uniform(size=tables * hashes)

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        """cells: (..., tables, hashes); a key for each, with the table in it."""
        key = np.broadcast_to(np.arange(self.shape[0], dtype=np.int64), cells.shape[:-1]).copy()
        for h in range(self.shape[1]):
            key = key * 1009 + cells[..., h] + 504
        return key

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        return self._keys(np.floor(unit @ self.lines + self.shift).astype(np.int64).reshape(-1, *self.shape))

    def probes(self, unit: np.ndarray, probes: int = PROBES) -> np.ndarray:
        """(queries, tables * probes) keys, those of each table in the order of estimated success."""
        tables, hashes = self.shape
        at = (unit @ self.lines + self.shift).reshape(-1, tables, hashes)
        cell = np.floor(at)
        inside = at - cell
        border = np.concatenate([inside, 1 - inside], axis=-1)
        order = border.argsort(axis=-1, kind="stable")
        out = []
        for over in probe_sets(hashes, probes):
            moved = cell.astype(np.int64)
            for x in over:
                which = order[..., x]
                step = np.where(which < hashes, -1, 1)
                np.put_along_axis(moved, (which % hashes)[..., None], np.take_along_axis(moved, (which % hashes)[..., None], -1) + step[..., None], -1)
            out.append(self._keys(moved))
        return np.stack(out, axis=-1).reshape(len(unit), -1)


def scaled(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors with their largest component between 1/2 and 1: a power of two changes no cosine and no digit, and squares stay in range."""
    x = x[:, :dimensions] if x.shape[1] >= dimensions else np.pad(x, ((0, 0), (0, dimensions - x.shape[1])))
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def _unit(x: np.ndarray, dimensions: int) -> np.ndarray:
    x = scaled(x, dimensions)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, piece: int = PIECE, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the ``k`` nearest rows found for each query.

    Every row is indexed in each table. A query visits its own bucket and the
    perturbed ones that are likeliest to hold its neighbours; buckets without
    rows are dropped from its list first, and buckets over ``piece`` rows are
    cut, each cut being visited. All candidates of a bucket are ranked by their
    exact cosine on the original vectors, and the tables' best are merged. A
    query that finds fewer than ``k`` candidates this way visits all rows.

    ``is_query`` says of the column ``id`` which rows ask; rows with the
    query's own id are no candidates; ties go to the smaller id. Rows whose id
    or vector is null, or whose vector is zero or holds a null or non-finite
    component, take no part; wholly repeated rows count once; shorter vectors
    count as filled up with zeros; no rows give no rows.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col).where(F.exists("v", lambda x: x != 0)).dropDuplicates()
    dimensions = rows.agg(F.max(F.size("v"))).first()[0] or 1
    hashed = PStableTables(dimensions, tables, hashes, width, seed)

    def keyed(of) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = of(_unit(matrix(batch.column("v"), dimensions), dimensions))
                ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["id", "v", "keys"])

        return run

    schema = "id long, v array<double>, keys array<long>"
    index = keep(rows.mapInArrow(keyed(hashed.buckets), schema), "index")
    asking = keep(rows.where(is_query).mapInArrow(keyed(lambda unit: hashed.probes(unit, probes)), schema), "asking")
    sizes = index.select(F.explode("keys").alias("key")).groupBy("key").agg(F.ceil(F.count("*") / piece).cast("int").alias("cuts"))
    cuts = keep(sizes, "cuts")
    held = index.select("id", "v", F.explode("keys").alias("key")).join(cuts, "key").select("key", F.pmod(F.xxhash64("id"), "cuts").cast("int").alias("cut"), F.lit(False).alias("asks"), "id", "v")
    visits = asking.select("id", F.explode("keys").alias("key")).join(cuts, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "id")
    visits = visits.join(asking.select("id", "v"), "id").select("key", "cut", F.lit(True).alias("asks"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        cell, data_ids, data, ready = None, [], [], None

        def flush() -> pa.RecordBatch:
            flat = [(q, i, -s) for q, own in best.items() for s, i in own]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys, cut, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cut", "asks"))
            ids, v = batch.column("id").to_numpy(), scaled(matrix(batch.column("v"), dimensions), dimensions)
            changes = np.flatnonzero((keys[1:] != keys[:-1]) | (cut[1:] != cut[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(keys)]):
                if (keys[a], cut[a]) != cell:
                    cell, data_ids, data, ready = (keys[a], cut[a]), [], [], None
                if not asks[a]:
                    data_ids.append(ids[a:b])
                    data.append(v[a:b])
                    continue
                if not data:
                    continue
                if ready is None:
                    points = np.concatenate(data)
                    ready = np.concatenate(data_ids), points, np.sqrt((points * points).sum(axis=1))
                names, points, norms = ready
                norm = np.sqrt((v[a:b] ** 2).sum(axis=1))
                rough = (v[a:b] @ points.T) / norms / norm[:, None]
                rough[ids[a:b][:, None] == names[None, :]] = -np.inf
                for i in range(b - a):
                    near = rough[i]
                    own = best.setdefault(int(ids[a + i]), [])
                    floor = -own[k - 1][0] if len(own) >= k else -np.inf
                    if len(near) > k:
                        floor = max(floor, float(np.partition(near, len(near) - k)[len(near) - k]))
                    take = np.flatnonzero((near >= floor - 1e-9) & (near > -np.inf))
                    if len(take):
                        exact = (points[take] * v[a + i]).sum(axis=1) / (norms[take] * norm[i])
                        best[int(ids[a + i])] = sorted({*own, *zip((-exact).tolist(), names[take].tolist())})[:k]
            if len(best) > 100_000:
                yield flush()
        yield flush()

    def best_of(rows_and_visits: DataFrame) -> DataFrame:
        cells = rows_and_visits.repartition(partitions(spark), "key", "cut").sortWithinPartitions("key", "cut", "asks")
        found = cells.mapInArrow(returning_memory(search), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    found = keep(best_of(held.union(visits)), "found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = keep(asking.select("id", "v").join(joinable(full), "id", "left_anti"), "short")
    if short.isEmpty():
        return found
    blocks = F.lit(max(1, -(-index.count() // piece)))
    every = index.select(F.lit(0).cast("long").alias("key"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("cut"), F.lit(False).alias("asks"), "id", "v")
    asked = short.select(F.lit(0).cast("long").alias("key"), F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("cut"), F.lit(True).alias("asks"), "id", "v")
    return found.join(joinable(short.select(F.col("id").alias("query_id"))), "query_id", "left_anti").union(best_of(every.union(asked)))
