"""Exact top-k search (operator 1).

The vectors are dealt by hash to shards of about ``SHARD`` rows, and every query is sent to every
shard. A task holds one shard as a matrix and lets the queries of that shard pass by in blocks: a
tile is the product of a block of queries and a part of the shard. Each tile gives k different ids
per query, tiles are merged as they come, and the shards' lists are merged by a tree of two levels in
Spark. Vectors and queries are scanned once each, whatever their number; nothing goes to the driver
but the count of vectors, and nothing is broadcast.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part,
nor do rows of null id; vectors are compared only with those of the same length; equal scores rank
the smaller id first; a query with fewer than k candidates returns all; rows of one id are one
candidate and one query, and a pair of ids scores the most that any of their rows do; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 4096
SHARD = 1 << 16


def usable(vector: Column) -> Column:
    """Not null or empty, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the length of each row of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row (score down, then id up); absent entries have id -1 sorted last."""
    if ids.shape[1] > k:
        kth = np.partition(scores, ids.shape[1] - k, axis=1)[:, ids.shape[1] - k][:, None]
        # at the border, ties of the smallest ids stay
        free = k - (scores > kth).sum(axis=1)
        tied = np.where(scores == kth, ids, np.iinfo(np.int64).max)
        last = np.sort(np.partition(tied, k - 1, axis=1)[:, :k], axis=1)[np.arange(len(ids)), free - 1][:, None]
        keep = (scores > kth) | ((scores == kth) & (ids <= last))
        # of equal ids at the border (absent entries) k stay
        keep &= np.cumsum(keep, axis=1) <= k
        ids, scores = ids[keep].reshape(-1, k), scores[keep].reshape(-1, k)
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def once(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of a row counts with its best score; its other places score -inf."""
    order = np.lexsort((-scores, ids), axis=1)
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    return ids, scores


def of_lengths(flat: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length: the length, the rows and their matrix."""
    begins = np.concatenate([[0], np.cumsum(lengths)])
    rows = [(int(d), np.flatnonzero(lengths == d)) for d in np.unique(lengths)]
    return [(d, at, flat[begins[at][:, None] + np.arange(d)]) for d, at in rows]


def search_tile(asked: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids of a shard for each query, a part of the shard at a time."""
    top = np.full((len(asked), 0), -1, np.int64), np.zeros((len(asked), 0))
    for a in range(0, len(ids), TILE):
        there = ids[a : a + TILE]
        scores = queries @ vectors[a : a + TILE].T
        scores[asked[:, None] == there[None, :]] = -np.inf
        found = np.broadcast_to(there, scores.shape)
        if len(np.unique(there)) < len(there):
            found, scores = once(found, scores)
        found, scores = best(found, scores, k)
        top = best(*once(np.hstack([top[0], found]), np.hstack([top[1], scores])), k)
    return top


def search_task(k: int):
    """Over rows sorted by shard, its vectors before the queries (``asks``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, matrices = None, [], None

        def searched(ids: np.ndarray, column: pa.Array) -> Iterator[pa.RecordBatch]:
            for d, at, queries in of_lengths(*matrix(column)):
                for n, there, vectors in matrices:
                    if n == d:
                        found, scores = search_tile(ids[at], queries, there, vectors, k)
                        row, place = np.nonzero(np.isfinite(scores))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at][row]), pa.array(found[row, place]), pa.array(scores[row, place])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            shards, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(shards)], strict=True):
                if shards[a] != shard:
                    shard, held, matrices = shards[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if matrices is None:
                    table = pa.Table.from_batches(held, batch.schema).combine_chunks()
                    ids = table.column("id").to_numpy()
                    matrices = [(d, ids[at], m) for d, at, m in of_lengths(*matrix(table.column("v").combine_chunks()))] if held else []
                    held = []
                for c in range(0, part.num_rows, TILE):
                    block = part.slice(c, TILE)
                    yield from searched(block.column("id").to_numpy(), block.column("v"))

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the k vectors of highest inner product."""

    def shaped(frame: DataFrame) -> DataFrame:
        kept = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return kept.where(F.col("id").isNotNull() & usable(F.col("v")))

    there = shaped(vectors)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(min(parts, -(-vectors.count() // TILE)), -(-vectors.count() // SHARD), 1)
    rows = there.select("id", "v", F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"))
    asked = shaped(queries).distinct().select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"))
    dealt = rows.unionAll(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    lists = dealt.mapInArrow(search_task(k), "query_id long, vec_id long, score double").withColumn("part", F.pmod(F.xxhash64(F.lit(4), "vec_id"), F.lit(16)))
    order = [F.desc("score"), F.asc("vec_id")]
    lists = lists.groupBy("query_id", "vec_id", "part").agg(F.max("score").alias("score"))
    for by in (["query_id", "part"], ["query_id"]):
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")
