"""A session gap that follows the alert rate.

The mean of the first 100 positive gaps between processed alerts is the base rate. From then on each positive gap moves
an exponential mean; when the base is at least three times the mean the session gap shrinks by a fifth, when it is at
most 0.33 of it the gap grows by a fifth, within half and one and a half times the starting gap.

Both recurrences compose: a step of the mean is an affine map, a step of the gap is ``clamp(a * x, lo, hi)``. Each block
of the processing order is therefore reduced to one map, the few maps are chained, and every block is then run from its
own starting state. Rows are never gathered.
"""

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

from alertfold.operators.ordering import RELEASE_ORDER
from alertfold.schema import MICROS

WARMUP = 100
ALPHA = 0.10
BUSY, QUIET = 3.0, 0.33
SHRINK, GROW = 0.80, 1.20


def _blocks(batches):
    """``(block, times)`` pieces in processing order; a block may arrive in several pieces."""
    for batch in batches:
        blocks, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("proc_block", "_ts"))
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield int(blocks[i]), times[i:j]


def _steps(times: np.ndarray, before: int | None) -> np.ndarray:
    """Distance of every row to the row before it; 0 for the first row of all."""
    return np.diff(times, prepend=times[0] if before is None else before)


def _summaries(narrow: DataFrame) -> list:
    """Per block: first and last time and its first positive inner gaps, at most as many as the warm-up needs."""
    def run(batches):
        found = {}
        for block, times in _blocks(batches):
            first, last, gaps = found.get(block, (int(times[0]), None, []))
            steps = _steps(times, last)
            gaps = [*gaps, *steps[steps > 0][: WARMUP - len(gaps)].tolist()]
            found[block] = (first, int(times[-1]), gaps)
        if found:
            yield pa.RecordBatch.from_pydict({
                "block": list(found), "first": [v[0] for v in found.values()], "last": [v[1] for v in found.values()],
                "gaps": [v[2] for v in found.values()]})

    return sorted(narrow.mapInArrow(run, "block long, first long, last long, gaps array<long>").collect())


def moving_average(values: np.ndarray, start: float, alpha: float, chunk: int = 128) -> np.ndarray:
    """The exponential mean after each value, from ``start`` on: a chunk at a time by its triangle of weights."""
    ages = np.arange(chunk)[:, None] - np.arange(chunk)[None, :]
    weights = np.where(ages >= 0, alpha * (1 - alpha) ** np.maximum(ages, 0), 0.0)
    fade, out = (1 - alpha) ** np.arange(1, chunk + 1), np.empty(len(values))
    for at in range(0, len(values), chunk):
        part = values[at:at + chunk]
        n = len(part)
        out[at:at + n] = weights[:n, :n] @ part + fade[:n] * start
        start = out[at + n - 1]
    return out


def _runs(factors: np.ndarray):
    """(first, end, factor) of runs of equal factors, those of 1 left out."""
    cuts = [0, *(np.flatnonzero(np.diff(factors)) + 1).tolist(), len(factors)]
    return ((i, j, float(factors[i])) for i, j in zip(cuts, cuts[1:]) if j > i and factors[i] != 1)


def _plan(summaries: list):
    """Time before each block, positive gaps counted before it (up to the warm-up) and the base gap in seconds."""
    before, seen, start, gaps = None, {}, {}, []
    for block, first, last, inner in summaries:
        start[block], seen[block] = before, len(gaps)
        if before is not None and first > before and len(gaps) < WARMUP:
            gaps.append(first - before)
        gaps.extend(inner[: WARMUP - len(gaps)])
        before = last
    base = sum(g / MICROS for g in gaps) / WARMUP if len(gaps) == WARMUP else None
    return start, seen, base


def with_adaptive_gap(ordered: DataFrame, base_minutes: float, alpha: float = ALPHA) -> DataFrame:
    """Add ``cur_dt_us``, the session gap in force when the row is processed, for rows in release order."""
    base_us = base_minutes * 60 * MICROS
    lo, hi = 0.5 * base_us, 1.5 * base_us
    placed = ordered.withColumn("_ts", F.unix_micros("timestamp")).repartition("proc_block").sortWithinPartitions(
        "proc_block", *RELEASE_ORDER).persist(StorageLevel.MEMORY_AND_DISK)
    narrow = placed.select("proc_block", "_ts")
    summaries = _summaries(narrow)
    start, seen, mean = _plan(summaries)
    order = [s[0] for s in summaries]

    def gaps_of(states, block, times):
        """Where the mean moves, and by which gaps (seconds); keeps the block's last time and number of positive gaps."""
        before, count = states.get(block, (start[block], seen[block]))
        steps = _steps(times, before)
        positive = steps > 0
        moves = np.flatnonzero(positive & (count + np.cumsum(positive) > WARMUP))
        states[block] = (int(times[-1]), count + int(positive.sum()))
        return moves, steps[moves] / MICROS

    def average_maps(batches):
        maps, states = {}, {}
        for block, times in _blocks(batches):
            a, c = maps.get(block, (1.0, 0.0))
            gaps = gaps_of(states, block, times)[1]
            # The mean after these gaps is a * mean + c; nothing but c is left of a long piece.
            maps[block] = (a * (1 - alpha) ** len(gaps), float(moving_average(gaps, c, alpha)[-1]) if len(gaps) else c)
        if maps:
            yield pa.RecordBatch.from_pydict({
                "block": list(maps), "a": [m[0] for m in maps.values()], "c": [m[1] for m in maps.values()]})

    averages, gap_at = {}, {b: float(base_us) for b in order}
    if mean is not None:
        found = {r.block: (r.a, r.c) for r in narrow.mapInArrow(average_maps, "block long, a double, c double").collect()}
        value = mean
        for b in order:
            averages[b] = value
            value = found[b][0] * value + found[b][1]

    def factors_of(flow, means, block, times):
        """Factor of every row, 1 where the gap stays."""
        factors = np.ones(len(times))
        moves, gaps = gaps_of(flow, block, times)
        if mean is not None and len(gaps):
            pace = moving_average(gaps, means.get(block, averages.get(block)), alpha)
            means[block] = float(pace[-1])
            ratio = np.divide(mean, pace, out=np.ones(len(pace)), where=pace > 0)
            factors[moves] = np.where(ratio >= BUSY, SHRINK, np.where(ratio <= QUIET, GROW, 1.0))
        return factors

    def limit(x, low, high):
        return min(max(x, low), high)

    def move(x, factor):
        # A shrink is only bounded below and a growth only above; within [lo, hi] both bounds may be applied.
        return limit(factor * x, lo, hi)

    def gap_maps(batches):
        maps, flow, means = {}, {}, {}
        for block, times in _blocks(batches):
            a, low, high = maps.get(block, (1.0, lo, hi))
            for i, j, factor in _runs(factors_of(flow, means, block, times)):
                for _ in range(j - i):
                    before = low, high
                    a, low, high = factor * a, move(low, factor), move(high, factor)
                    if low == high == before[0]:  # at a bound, where a run of this factor stays
                        break
            maps[block] = (a, low, high)
        if maps:
            rows = list(maps.values())
            yield pa.RecordBatch.from_pydict({
                "block": list(maps), "a": [r[0] for r in rows], "lo": [r[1] for r in rows], "hi": [r[2] for r in rows]})

    if mean is not None:
        schema = "block long, a double, lo double, hi double"
        found = {r.block: (r.a, r.lo, r.hi) for r in narrow.mapInArrow(gap_maps, schema).collect()}
        value = float(base_us)
        for b in order:
            gap_at[b] = value
            a, low, high = found[b]
            value = limit(a * value, low, high)

    names = [c for c in placed.columns if c != "_ts"]

    def run(batches):
        flow, means, current = {}, {}, {}
        for batch in batches:
            out = []
            for block, times in _blocks([batch]):
                value, at = current.get(block, gap_at[block]), 0
                gap = np.empty(len(times))
                for i, j, factor in _runs(factors_of(flow, means, block, times)):
                    gap[at:i] = value
                    for at in range(i, j):
                        before, value = value, move(value, factor)
                        gap[at] = value
                        if value == before:
                            break
                    gap[at:j] = value
                    at = j
                gap[at:] = value
                current[block] = value
                out.append(np.rint(gap).astype("int64"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(np.concatenate([np.zeros(0, "int64"), *out]))], names=[*names, "cur_dt_us"])

    schema = T.StructType([*ordered.schema.fields, T.StructField("cur_dt_us", T.LongType())])
    return placed.mapInArrow(run, schema)


def gap_history(adapted: DataFrame) -> DataFrame:
    """The series of gaps, keyed by processing order."""
    return adapted.select(*RELEASE_ORDER, F.unix_micros("timestamp").alias("ts_us"),
                          (F.col("cur_dt_us") / (60 * MICROS)).alias("dt_min"))


def gap_summary(adapted: DataFrame) -> DataFrame:
    dt = F.col("cur_dt_us") / (60 * MICROS)
    return adapted.agg(
        F.count("*").alias("n"), F.round(F.min(dt), 4).alias("min_dt_min"), F.round(F.max(dt), 4).alias("max_dt_min"),
        F.round(F.max_by(dt, F.struct("proc_block", *RELEASE_ORDER)), 4).alias("final_dt_min"))
