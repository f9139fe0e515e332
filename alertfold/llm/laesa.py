"""Compression of vectors to codes: one codebook per part, searched with fixed pivots (LAESA).

The distances from every part of every vector to a few fixed pivots are computed once and stored. A round computes the
distances from pivots to codebook entries; by the triangle inequality the difference of the two is a lower bound of a
part's distance to an entry. Entries are tried in the order of their largest bound until the bound passes the best exact
integer distance, so an entry that could be equally near is always tried and ties go to the lower index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertfold.llm.common import stored
from alertfold.llm.int_vectors import floor_means, floored, matrix, sound, totals

ROWS_AT_ONCE = 8192
# Pivot distances are stored in single precision: bounds are lowered by more than that rounding.
SLACK = 1e-6


def choose_pivots(entries: np.ndarray, pivots: int) -> np.ndarray:
    """``pivots`` of the entries of each part, each the farthest from those before it; the first is the first entry."""
    found = np.zeros((len(entries), pivots), np.int64)
    for p, book in enumerate(entries):
        nearest = ((book - book[0]) ** 2).sum(1)
        for k in range(1, pivots):
            found[p, k] = nearest.argmax()
            nearest = np.minimum(nearest, ((book - book[found[p, k]]) ** 2).sum(1))
    return np.take_along_axis(entries, found[:, :, None], 1)


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of (n, parts, width) to (parts, pivots, width): (n, parts, pivots)."""
    return np.sqrt(((parts[:, :, None, :] - pivots[None]) ** 2).sum(3)).astype(np.float32)


def nearest_entries(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each point of one part, and how many distances were evaluated."""
    bound = np.zeros((len(points), len(entries)), np.float32)
    for k in range(to_pivots.shape[1]):
        a, b = to_pivots[:, k, None], entry_pivots[None, :, k]
        np.maximum(bound, np.abs(a - b) - np.float32(SLACK) * (a + b), out=bound)
    order = bound.argsort(1)
    bound = np.take_along_axis(bound, order, 1).astype(np.float64) ** 2
    best = np.full(len(points), np.iinfo(np.int64).max)
    pick = np.full(len(points), len(entries))
    live, evaluated = np.arange(len(points)), 0
    for step in range(len(entries)):
        # Inclusive: an entry at the bound can still tie. The factor covers the rounding of the square.
        live = live[bound[live, step] * (1 - 1e-6) <= best[live]]
        if not len(live):
            break
        entry = order[live, step]
        distance = ((points[live] - entries[entry]) ** 2).sum(1)
        evaluated += len(live)
        better = (distance < best[live]) | ((distance == best[live]) & (entry < pick[live]))
        best[live[better]], pick[live[better]] = distance[better], entry[better]
    return pick, best, evaluated


def _assign(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, codes, errors) for slices of rows; codes and errors have one column per part."""
    for at in range(0, len(parts), ROWS_AT_ONCE):
        rows = slice(at, at + ROWS_AT_ONCE)
        found = [nearest_entries(parts[rows, p], to_pivots[rows, p], entries[p], entry_pivots[p]) for p in range(parts.shape[1])]
        yield parts[rows], np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", into: str = "coded", parts: int = 16,
             entries: int = 64, rounds: int = 2, pivots: int = 4) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` without the vector column and with the struct ``into``: code (hex, two digits per part), error; and the
    codebooks as an array (parts, entries, width).

    Rows whose vector is null or holds null or non-finite components take no part, nor do vectors whose length is not the
    most frequent one among lengths that ``parts`` divides (the longest of equally frequent ones), nor components of
    131,072 and more, whose distances could pass 64 bits. Component x counts as floor(256 * x). The first codebooks are
    those parts of the rows with the ``entries`` smallest ids (null ids last, equal ids by their components); fewer rows
    give fewer entries. A round replaces each entry by the floored means of its parts, an unused entry stays. Repeated
    rows get equal codes; an empty table gives no rows and no codebooks; other columns pass unchanged and an existing column
    named ``into`` is replaced. Ties go to the lower index.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256, as two hex digits hold an index")
    others = [c for c in vectors.columns if c not in (vector, into)]
    rows = vectors.where(sound(F.col(vector))).select(
        F.struct(F.col(id_column).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(others)]).alias("row"),
        floored(F.col(vector)).alias("q"))
    sizes = rows.groupBy(F.size("q").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    size = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    width = size["n"] // parts if size else 0
    rows = rows.where(F.size("q") == width * parts)
    first = rows.orderBy(F.asc_nulls_last("row.id"), "q").limit(entries).select("q").toArrow() if size else None
    if first is None:
        coded = rows.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return _outside(coded, others, into), np.zeros((parts, 0, 0), np.int64)
    books = matrix(first.column("q").combine_chunks(), width * parts).astype(np.int64).reshape(-1, parts, width).swapaxes(0, 1)
    fixed = choose_pivots(books, min(pivots, books.shape[1]))

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch.column("q"), width * parts).astype(np.int64).reshape(-1, parts, width)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pivot_distances(cut(batch)[at:at + ROWS_AT_ONCE], fixed).reshape(-1) for at in range(0, batch.num_rows, ROWS_AT_ONCE)]
            flat = np.concatenate(found) if found else np.zeros(0, np.float32)
            per_row = parts * fixed.shape[1]
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * per_row, pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "pivot"])

    index = stored(rows.mapInArrow(measure, f"{_fields(rows)}, pivot array<float>"), "laesa")

    def assigned(batch: pa.RecordBatch, books: np.ndarray, entry_pivots: np.ndarray):
        to_pivots = matrix(batch.column("pivot"), parts * fixed.shape[1]).reshape(-1, parts, fixed.shape[1])
        return _assign(cut(batch), to_pivots, books, entry_pivots)

    for _ in range(rounds):
        between = pivot_distances(books.swapaxes(0, 1), fixed).swapaxes(0, 1)

        def add(sums: np.ndarray, batch: pa.RecordBatch, books=books, between=between) -> None:
            for points, codes, _ in assigned(batch, books, between):
                for p in range(parts):
                    for j in range(width):
                        # Sums of a slice stay below 2**53, so that doubles add them exactly.
                        sums[p, :, j] += np.bincount(codes[:, p], points[:, p, j], books.shape[1]).astype(np.int64)
                    sums[p, :, width] += np.bincount(codes[:, p], minlength=books.shape[1])

        sums = totals(index.select("q", "pivot"), (parts, books.shape[1], width + 1), add)
        books = floor_means(sums[..., :width], sums[..., width], books)
    between = pivot_distances(books.swapaxes(0, 1), fixed).swapaxes(0, 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(assigned(batch, books, between))
            codes = [bytes(c).hex() for _, part, _ in found for c in part.astype(np.uint8)]
            errors = np.concatenate([np.zeros(0, np.int64), *(e.sum(1) for _, _, e in found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(codes, pa.string()), pa.array(errors)], ["row", "code", "error"])

    coded = index.mapInArrow(encode, f"{_fields(rows.select('row'))}, code string, error long")
    return _outside(coded, others, into), books


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _outside(coded: DataFrame, others: list[str], into: str) -> DataFrame:
    return coded.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(others)], F.struct("code", "error").alias(into))


def flat_text(books: np.ndarray) -> str:
    """All entries' components by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def oracle(table: str, parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 4) -> str:
    """Codes, errors and codebooks in DuckDB's SQL, by comparing every part with every entry."""
    comp = range(width)
    near = (f"SELECT vec_id, p, min(d) AS d, arg_min(e, d * {entries} + e) AS e FROM (SELECT a.vec_id, a.p, b.e, "
            + " + ".join(f"(a.x{j} - b.x{j}) * (a.x{j} - b.x{j})" for j in comp) + " AS d FROM part a JOIN {book} b ON a.p = b.p) GROUP BY vec_id, p")
    steps = []
    for r in range(rounds):
        means = ", ".join(f"coalesce(m.x{j}, b.x{j}) AS x{j}" for j in comp)
        floors = ", ".join(f"CAST((sum(x{j}) - ((sum(x{j}) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS x{j}" for j in comp)
        steps.append(f"near{r} AS MATERIALIZED ({near.format(book=f'book{r}')})")
        steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, {means} FROM book{r} b LEFT JOIN (SELECT p, e, {floors} "
                     f"FROM part JOIN near{r} USING (vec_id, p) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)")
    cells = ", ".join(f"q[{width} * p + {j + 1}] AS x{j}" for j in comp)
    texts = " || ',' || ".join(f"x{j}" for j in comp)
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM {table} WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, p, {cells} FROM kept, range({parts}) r(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, {', '.join(f'x{j}' for j in comp)}
  FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
{', '.join(steps)},
last AS MATERIALIZED ({near.format(book=f'book{rounds}')}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM last JOIN kept USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg({texts}, ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""
