"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately; the pair of nearest centroids is the vector's cell. For a query the
pairs of centroids are visited by the sum of their two distances, smallest first, with a heap over the two sorted lists,
until the visited cells hold the wanted share of all entries. The entries of those cells are ranked by the exact inner
product. Entries are dealt out by a hash of their id, so a cell of any size is spread over all shards, and shards meet
the queries in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from alertfold.llm.common import stored

RESULT = "query_id long, vec_id long, score double"
SHARD, SHARDS_AT_LEAST, SMALLEST_SHARD, QUERY_BLOCK, QUERIES_AT_ONCE = 16384, 16, 512, 2048, 256


def fit_half(points: np.ndarray, centroids: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k-means with rows drawn as first centroids; an empty cluster keeps its centroid."""
    start = np.random.default_rng(seed).permutation(len(points))[:centroids]
    found = points[start].copy()
    for _ in range(rounds):
        of = _nearest(points, found)
        for k in range(len(found)):
            if (of == k).any():
                found[k] = points[of == k].mean(0)
    return found


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points ** 2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids ** 2).sum(1)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return _distances(points, centroids).argmin(1)


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: int) -> list[int]:
    """Cells by summed distance until they hold ``need`` entries. ``counts`` is a matrix of entries per pair."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, held = first[a].tolist(), second[b].tolist(), counts[a][:, b].tolist()
    heap, cells, total, width = [(x[0] + y[0], 0, 0)], [], 0, len(y)
    while heap and total < need:
        _, i, j = heappop(heap)
        if held[i][j]:
            cells.append(int(a[i]) * width + int(b[j]))
            total += held[i][j]
        if j + 1 < width:
            heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of ``scores`` above minus infinity, ties to smaller ids; scores are summed anew in one order."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > k:
        least = np.partition(scores[at], -k)[-k]
        at = at[scores[at] >= least - 1e-9 * (1 + abs(least))]
    exact = (vectors[at] * query).sum(1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def _search_shard(ids, cells, vectors, query_ids, queries, wanted, k) -> Iterator[tuple]:
    """Rows of ``RESULT`` as arrays, for one shard and one block of queries."""
    order = np.argsort(cells, kind="stable")
    ids, cells, vectors = ids[order], cells[order], vectors[order]
    present, start = np.unique(cells, return_index=True)
    end = np.append(start[1:], len(cells))
    for at in range(0, len(query_ids), QUERIES_AT_ONCE):
        part = wanted[at:at + QUERIES_AT_ONCE]
        of = np.repeat(np.arange(len(part)), [len(w) for w in part])
        cell = np.concatenate(part)
        here = np.searchsorted(present, cell)
        met = present[np.minimum(here, len(present) - 1)] == cell
        of, here = of[met], here[met]
        by = np.argsort(here, kind="stable")
        cuts = np.searchsorted(here[by], np.arange(len(present) + 1))
        scores = np.full((len(part), len(ids)), -np.inf)
        for c in range(len(present)):
            rows = of[by[cuts[c]:cuts[c + 1]]]
            if len(rows):
                scores[rows, start[c]:end[c]] = queries[at + rows] @ vectors[start[c]:end[c]].T
        scores[ids[None, :] == query_ids[at:at + len(part), None]] = -np.inf
        for q in range(len(part)):
            found, score = _best(ids, vectors, queries[at + q], scores[q], k)
            yield np.full(len(found), query_ids[at + q]), found, score


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Rows (vec_id, vec) that take part: with an id, and with a vector that is neither null nor zero, holds finite numbers
    only and has the most frequent length (the longest of equally frequent ones)."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & F.exists("vec", lambda x: x != 0) & F.forall(
            "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vec") == (size["d"] if size else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding",
           centroids: int = 64, share: float = 0.6, fit_rows: int = 16384) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank from 1, vec_id, score (inner product in double precision).

    Queries are the usable rows for which ``is_query`` (a condition on ``vec_id``) holds, one per id; every other usable
    row is a candidate, also rows that repeat an id, except those with the query's own id. Only the centroids are
    fitted on a sample: the ``fit_rows`` rows with the smallest hash of their id. Every row is in the index.
    ``share`` of all entries are ranked per query: the price of recall on data without clusters (see README). Null vectors
    or ids, zero and non-finite vectors take no part; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = len(sample.column("vec")[0])
    points = _matrix(sample.column("vec").combine_chunks(), dims)
    half = (dims + 1) // 2
    first = fit_half(points[:, :half], centroids)
    second = fit_half(points[:, half:], centroids) if dims > 1 else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), dims)
            cell = _nearest(points[:, :half], first) * len(second) + _nearest(points[:, half:], second)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "vec", "cell"])

    index = stored(rows.mapInArrow(assign, "vec_id long, vec array<double>, cell int"), "multi-index")
    counts = np.zeros(len(first) * len(second), np.int64)
    for row in index.groupBy("cell").count().collect():  # at most one row per pair of centroids
        counts[row["cell"]] = row["count"]
    total = int(counts.sum())
    shards = max(-(-total // SHARD), min(SHARDS_AT_LEAST, -(-total // SMALLEST_SHARD)))
    need, table = max(int(np.ceil(share * total)), k + 1), counts.reshape(len(first), len(second))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), dims)
            near = [_distances(points[:, :half], first), _distances(points[:, half:], second)]
            cells = [visit(a, b, table, need) for a, b in zip(*near)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], ["query_id", "query", "cells"])

    asked = index.where(is_query).dropDuplicates(["vec_id"]).select("vec_id", "vec")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = (asked.mapInArrow(route, "query_id long, query array<double>, cells array<int>")
               .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    entries = (index.withColumn("shard", F.pmod(F.xxhash64("vec_id", "cell"), F.lit(shards)).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def meet(entries: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        if entries.num_rows and queries.num_rows:
            numbers = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            matrix = lambda t, c: _matrix(t.column(c).combine_chunks(), dims)
            wanted = [np.asarray(x, np.int64) for x in queries.column("cells").to_pylist()]
            parts = list(_search_shard(numbers(entries, "vec_id"), numbers(entries, "cell"), matrix(entries, "vec"),
                                       numbers(queries, "query_id"), matrix(queries, "query"), wanted, k))
        joined = lambda i, kind: np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)])
        return pa.table({"query_id": joined(0, np.int64), "vec_id": joined(1, np.int64), "score": joined(2, np.float64)})

    found = entries.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(meet, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
