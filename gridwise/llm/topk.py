"""Exact top-k inner products with a pivot table.

Distances of every vector to some pivots are computed once. By the triangle inequality their largest difference is a
lower bound of the distance of two vectors, and so an upper bound of their inner product. Each query evaluates the few
candidates of a block with the highest bounds, and then, at once, those whose bound reaches the k-th best score found.

Rows with a null id, a null vector, or null or non-finite components take no part; only vectors of a query's dimension
are compared with it. Every row is a row of its own: of two rows with one id, each is a candidate of the other, and each has
its own ranks if it is a query. Ties go to the smaller id, fewer candidates than k give fewer rows. Blocks
are dealt by a hash of the row, so equal vectors don't meet in one task, and a block's size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.llm.common import stored

CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 4096
DIMENSIONS = 8
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id: str, vector: str, scale: int, more: Sequence[str] = ()) -> DataFrame:
    """Rows (id, v) with v = floor(scale * component), and the columns `more`."""
    x = F.col(f"`{vector}`").cast("array<double>")
    usable = F.col(f"`{id}`").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    )
    return vectors.where(usable).select(
        F.col(f"`{id}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("double")).alias("v"),
        *[f"`{c}`" for c in more],
    )


def with_pivot_distances(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Rows with `d`, the distances to the pivots of the same dimension."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            distances = [
                np.sqrt(((pivots[len(v)] - v) ** 2).sum(axis=1)) if len(v) in pivots else np.empty(0) for v in frame["v"]
            ]
            yield frame.assign(v=[np.asarray(v, "<f8").tobytes() for v in frame["v"]], d=[x.tobytes() for x in distances])

    return rows.mapInPandas(run, "id long, v binary, row long, d binary")


def stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def best_in_block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> tuple[list[int], list[int], list[int], int]:
    """Up to k (place of the query, candidate, score) for each query within one block, and how many products that took."""
    q, c, dq, dc = stack(queries["v"]), stack(block["v"]), stack(queries["d"]), stack(block["d"])
    ids, rows = block["id"].to_numpy(), block["row"].to_numpy()
    square = (c * c).sum(axis=1)
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    evaluated = 0
    largest = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    exact = largest * largest * max(1, q.shape[1]) < EXACT
    whole = None if exact else c.astype(object)
    products = lambda at, i: c[at] @ q[i] if exact else whole[at] @ q[i].astype(object)
    for i in range(len(q)):
        mine = float(q[i] @ q[i])
        bound = np.abs(dc - dq[i]).max(axis=1, initial=0)
        upper = (mine + square - bound * bound) / 2
        upper += 1e-9 * (mine + square) + 0.5  # rounding; scores are integers
        upper[rows == queries["row"].iat[i]] = -np.inf
        # The candidates with the highest bounds give a score that the k best reach; then all whose bound reaches it.
        some = min(4 * k, len(upper))
        first = np.argpartition(-upper, some - 1)[:some]
        first = first[upper[first] > -np.inf]
        score = products(first, i)
        evaluated += len(first)
        if len(first) >= k:
            more = upper >= np.sort(score)[-k]
            more[first] = False
            more = np.flatnonzero(more)
            first, score = np.concatenate([first, more]), np.concatenate([score, products(more, i)])
            evaluated += len(more)
            high = score >= np.sort(score)[-k]
            first, score = first[high], score[high]
        ranked = sorted(zip(map(int, score), ids[first].tolist()), key=lambda x: (-x[0], x[1]))[:k]
        out[0].extend([i] * len(ranked))
        out[1].extend(x[1] for x in ranked)
        out[2].extend(x[0] for x in ranked)
    return *out, evaluated


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding",
    pivots: int = 32,
) -> DataFrame:
    """For rows where `is_query` holds, their k best other rows: query_id, rank, vec_id, score.

    The `pivots` rows with the lowest hashes of each dimension are pivots, for the `DIMENSIONS` most frequent dimensions;
    rows of other dimensions are compared without bounds.
    """
    given = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    numbered = quantised(given, "id", "vector", scale, ["asks"]).withColumn("row", F.monotonically_increasing_id())
    usable = stored(numbered, "vectors")
    queries, usable = usable.where("asks").drop("asks"), usable.drop("asks")
    sizes = usable.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(DIMENSIONS)
    first = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("v"), "id")
    chosen = usable.where(F.size("v").isin([r["n"] for r in sizes.collect()]))
    chosen = chosen.withColumn("at", F.row_number().over(first)).where(F.col("at") <= pivots)
    points: dict[int, list[list[float]]] = {}
    for row in chosen.select("v").collect():
        points.setdefault(len(row["v"]), []).append(row["v"])
    table = {n: np.array(v) for n, v in points.items()}
    left, right = with_pivot_distances(queries, table), with_pivot_distances(usable, table)
    blocks = max(1, -(-usable.count() // CANDIDATES_PER_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    left = left.withColumn("qb", block(query_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    right = right.withColumn("cb", block(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")))
    left, right = (x.withColumn("dim", F.length("v")) for x in (left, right))

    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: tuple = ([], [], [])
        if len(queries) and len(block):
            found = best_in_block(queries, block, k)[:3]
        asked = queries.iloc[found[0]]
        return pd.DataFrame({
            "query": asked["row"].to_numpy(), "query_id": asked["id"].to_numpy(), "vec_id": found[1], "score": found[2],
        }).astype("int64")

    pairs = left.groupBy("qb", "cb", "dim").cogroup(right.groupBy("qb", "cb", "dim")).applyInPandas(run, "query long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
