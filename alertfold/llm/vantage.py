"""Clustering around centroids, each vector's nearest centroid found in a vantage-point tree.

Every round builds the tree of its centroids on the driver and broadcasts it. A vector walks the tree best first: the
open node with the smallest lower bound is next, until that bound passes the best exact distance found. All vectors of a
batch walk together, each with its own row of open bounds. Distances to vantage points and in leaves are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertfold.llm.common import stored
from alertfold.llm.int_vectors import floor_means, floored, matrix, sound, totals

ROWS_AT_ONCE, LEAF = 4096, 4
SLACK = 1e-9  # square roots are rounded; bounds are lowered by more than that


@dataclass
class Node:
    """A leaf holds centroid numbers. Another node has a vantage centroid, and per child its number and the range of the
    child's distances to the vantage centroid."""
    centroids: list[int]
    children: list[tuple[int, float, float]]


def build(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """Nodes of the tree, the root first. Sides are split at the median distance; equal points may lie on both sides."""
    nodes: list[Node] = []

    def grow(members: list[int]) -> int:
        me = len(nodes)
        nodes.append(Node(members, []))
        if len(members) <= leaf:
            return me
        vantage, rest = members[0], np.array(members[1:])
        far = np.sqrt(((centroids[rest] - centroids[vantage]) ** 2).sum(1).astype(np.float64))
        order = np.argsort(far, kind="stable")
        nodes[me].centroids = [vantage]
        for side in np.array_split(order, 2):
            if not len(side):
                continue
            nodes[me].children.append((grow(rest[side].tolist()), float(far[side].min()), float(far[side].max())))
        return me

    if len(centroids):
        grow(list(range(len(centroids))))
    return nodes


def nearest(points: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each point's nearest centroid (ties: the smaller number), and the evaluations made."""
    open_bounds = np.full((len(points), len(nodes)), np.inf)
    open_bounds[:, 0] = 0
    best = np.full(len(points), np.iinfo(np.int64).max)
    pick = np.full(len(points), len(centroids))
    live, evaluated = np.arange(len(points)), 0
    while len(live):
        node = open_bounds[live].argmin(1)
        bound = open_bounds[live, node]
        # Inclusive: what lies exactly at the best distance can still win by its number.
        on = (bound < np.inf) & (bound * bound * (1 - SLACK) <= best[live])
        live, node, bound = live[on], node[on], bound[on]
        open_bounds[live, node] = np.inf
        for n in np.unique(node):
            at = node == n
            rows, low = live[at], bound[at]
            for c in nodes[n].centroids:
                distance = ((points[rows] - centroids[c]) ** 2).sum(1)
                evaluated += len(rows)
                better = (distance < best[rows]) | ((distance == best[rows]) & (c < pick[rows]))
                best[rows[better]], pick[rows[better]] = distance[better], c
            if nodes[n].children:
                root = np.sqrt(distance.astype(np.float64))
                for child, least, most in nodes[n].children:
                    slack = SLACK * (root + most)
                    open_bounds[rows, child] = np.maximum(low, np.maximum(root - most, least - root) - slack)
    return pick, best, evaluated


def _walk(points: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, len(points), ROWS_AT_ONCE):
        part = points[at:at + ROWS_AT_ONCE]
        yield part, *nearest(part, centroids, nodes)[:2]


def cluster(vectors: DataFrame, k: int, rounds: int, id_column: str = "vec_id", vector: str = "embedding", dims: int = 64,
            seed: int = 2, into: str = "clustered", leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` without the vector column and with the struct ``into``: cluster, distance (squared); and the centroids.

    Rows take part whose vector has exactly ``dims`` components, none null, not finite, or of 131,072 and more (their
    distances could pass 64 bits). Component x counts as floor(256 * x). The first centroids are the ``k`` rows with the
    smallest SHA-256 of ``seed:id`` (equal ids by their components, null ids last); fewer rows give fewer centroids. A
    round replaces each centroid by the floored means of its vectors, one without vectors stays. Repeated rows get equal
    results; an empty table gives no rows and no centroids; other columns pass unchanged, an existing column named
    ``into`` is replaced. The tree and one task's sums hold ``k`` centroids; rows are never grouped, so a cluster of any
    size is as good as another.
    """
    others = [c for c in vectors.columns if c not in (vector, into)]
    rows = vectors.where((F.size(vector) == dims) & sound(F.col(vector))).select(
        F.struct(F.col(id_column).alias("id"), *[F.col(c).alias(f"c{j}") for j, c in enumerate(others)]).alias("row"),
        floored(F.col(vector)).alias("q"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("row.id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(F.asc_nulls_last(hashed), "q").limit(k).select("q").toArrow()
    centroids = (matrix(first.column("q").combine_chunks(), dims) if first.num_rows else np.zeros((0, dims))).astype(np.int64)
    if not len(centroids):
        found = rows.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return _outside(found, others, into), centroids
    kept, context = stored(rows, "vectors"), vectors.sparkSession.sparkContext
    points = lambda batch: matrix(batch.column("q"), dims).astype(np.int64)
    for _ in range(rounds):
        tree = context.broadcast((centroids, build(centroids, leaf)))

        def add(sums: np.ndarray, batch: pa.RecordBatch, tree=tree) -> None:
            for part, number, _ in _walk(points(batch), *tree.value):
                for j in range(dims):
                    # Sums of a slice stay below 2**53, so that doubles add them exactly.
                    sums[:, j] += np.bincount(number, part[:, j], len(sums)).astype(np.int64)
                sums[:, dims] += np.bincount(number, minlength=len(sums))

        sums = totals(kept.select("q"), (len(centroids), dims + 1), add)
        centroids = floor_means(sums[:, :dims], sums[:, dims], centroids)
    tree = context.broadcast((centroids, build(centroids, leaf)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_walk(points(batch), *tree.value))
            numbers = np.concatenate([np.zeros(0, np.int64), *(n for _, n, _ in found)]).astype(np.int32)
            squared = np.concatenate([np.zeros(0, np.int64), *(d for _, _, d in found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(numbers), pa.array(squared)], ["row", "cluster", "distance"])

    row_type = rows.schema["row"].dataType.simpleString()
    return _outside(kept.mapInArrow(assign, f"row {row_type}, cluster int, distance long"), others, into), centroids


def _outside(found: DataFrame, others: list[str], into: str) -> DataFrame:
    return found.select(*[F.col(f"row.c{j}").alias(c) for j, c in enumerate(others)], F.struct("cluster", "distance").alias(into))


def fingerprint(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def oracle(table: str, k: int, rounds: int, dims: int = 64, seed: int = 2) -> str:
    """Clusters and distances in DuckDB's SQL, by comparing every vector with every centroid."""
    near = ("SELECT vec_id, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM (SELECT a.vec_id, b.c, list_sum(list_transform(range(1, {dims} + 1), "
            "lambda i: (a.q[i] - b.q[i]) * (a.q[i] - b.q[i]))) AS d FROM kept a CROSS JOIN {means} b) GROUP BY vec_id")
    steps = []
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({near.format(k=k, dims=dims, means=f'mean{r}')})")
        steps.append(f"mean{r + 1} AS MATERIALIZED (SELECT b.c, coalesce(m.q, b.q) AS q FROM mean{r} b LEFT JOIN ("
                     "SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS q FROM (SELECT c, i, sum(q[i]) AS s, count(*) AS n "
                     f"FROM kept JOIN near{r} USING (vec_id), range(1, {dims} + 1) t(i) GROUP BY c, i) GROUP BY c) m ON m.c = b.c)")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM {table} WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
mean0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (
  SELECT sha256('{seed}:' || vec_id) AS h, q FROM kept ORDER BY h LIMIT {k})),
{', '.join(steps)},
last AS MATERIALIZED ({near.format(k=k, dims=dims, means=f'mean{rounds}')})
SELECT vec_id, CAST(last.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY last.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(q, ',')) AS centroid_sha256
FROM last JOIN mean{rounds} m ON m.c = last.c"""
