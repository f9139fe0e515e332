"""Vectors of integers for exact clustering: floor(scale * x), and sums over all rows that tasks form before they are added."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Squared distances of vectors within this bound fit 64 bits up to a thousand components.
LIMIT = 1 << 25


def floored(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as ints; null where a component is not within ``LIMIT``."""
    return F.transform(vector, lambda x: F.when(
        F.abs(x.cast("double")) * scale < LIMIT, F.floor(F.lit(scale) * x.cast("double")).cast("int")))


def sound(vector: Column, scale: int = 256) -> Column:
    """Whether a vector takes part: not null, no component null, not finite or beyond ``LIMIT`` when scaled."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LIMIT))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of ``width`` numbers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def totals(rows: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """Exact sums over all rows: ``add(sums, batch)`` adds a batch to a task's own array, tasks' arrays are added by cell.

    A task gives at most as many rows as the array has cells, and so does the result that the driver gets: its size
    follows ``shape`` and not the rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape, np.int64)
        for batch in batches:
            add(sums, batch)
        flat = sums.ravel()
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], ["cell", "total"])

    found = np.zeros(int(np.prod(shape)), np.int64)
    for row in rows.mapInArrow(run, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        found[row["cell"]] = row["total"]
    return found.reshape(shape)


def floor_means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) by row; rows without a count keep ``old``."""
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], old)
