"""Exact top-k search by inner product: cover trees over blocks of queries and of data, searched together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.cover_tree import dual_tree_search
from cadence.llm.shared import partitions
from cadence.llm.vectors import matrix, usable, widened

#: Vectors in a block of queries and in a block of data; a task holds one of each.
QUERY_BLOCK, DATA_BLOCK = 4096, 8192
#: Sums of products of two vectors are at most the root of their sums of squares.
LARGEST = float(2**52)


def exact_topk(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows of the largest integer inner product for each query.

    Every component x counts as floor(scale * x). ``is_query`` says of the
    column ``id`` which rows ask; all rows but those with the query's own id are
    candidates, and ties go to the smaller id. Blocks have a bounded size, and
    each block of queries meets each block of data in a task of its own, which
    hands on k rows for each query.

    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part; wholly repeated rows count once; vectors of
    different lengths count as filled up with zeros; no rows give no rows.
    Scores are exact: a vector whose scaled squares sum up to 2 ** 52 or more
    raises, as doubles would not hold every sum of products with it.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col).select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("v"))
    exact = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x) < LARGEST
    rows = rows.select("id", F.when(exact, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("the vector is too large for exact scores: "), F.col("id").cast("string"))).cast("array<double>")).alias("v")).dropDuplicates()
    counts = df.select(F.col(id_col).alias("id")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    over_data, over_queries = max(1, -(-counts.n // data_block)), max(1, -(-counts.q // query_block))
    place = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("id", "v", F.lit(False).alias("asks"), F.pmod(place, F.lit(over_data)).cast("int").alias("d")).select("*", every(over_queries).alias("q"))
    asking = rows.where(is_query).select("id", "v", F.lit(True).alias("asks"), F.pmod(place, F.lit(over_queries)).cast("int").alias("q")).select("*", every(over_data).alias("d"))
    cells = data.select("id", "v", "asks", "q", "d").union(asking.select("id", "v", "asks", "q", "d")).repartition(partitions(spark), "q", "d")

    def search(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks").to_numpy()
        parts = [cell.filter(pa.array(mask)) for mask in (asks, ~asks)]
        vectors = [matrix(p.column("v")) for p in parts]
        width = max(x.shape[1] for x in vectors)
        ids = [p.column("id").to_numpy() for p in parts]
        query_id, vec_id, score = dual_tree_search(widened(vectors[0], width), ids[0], widened(vectors[1], width), ids[1], k)
        return pa.table({"query_id": query_id, "vec_id": vec_id, "score": score.astype(np.int64)})

    found = cells.groupBy("q", "d").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
