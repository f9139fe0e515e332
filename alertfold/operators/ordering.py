"""Arrival order, bounded reordering and lateness.

A reorder buffer of size ``k`` that always releases its earliest alert keeps the ``k - 1`` latest seen so far, so the
last one released before arrival ``j`` is the k-th largest ``(time, arrival)`` pair among the first ``j - 1`` arrivals.
That value is a running top-k, and top-k is mergeable, so the reordering is a prefix scan over blocks of the arrival
order:

1. cut the arrival order into blocks of near-equal row count (bounds come from a deterministic key sample that is taken
   while the rows are counted, so a tied or bursty arrival time is split as well),
2. reduce every block to its top-k and its row count,
3. merge the block states in a tree of stored tables, upwards to larger and larger ranges of blocks and down again, which
   gives every block its starting state,
4. shuffle the rows once by block, each block's starting state in front of its rows, and run each block from there.

States never leave the executors: the driver gets the row count and one bound per block, 16 bytes for a million rows.
Blocks depend only on row values, so a lost task recomputes to the same result.
"""

from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window, functions as F, types as T

from alertfold.schema import MICROS
from alertfold.session import stored

ROWS_PER_BLOCK = 1_000_000
SAMPLES_PER_BLOCK = 32
BOUNDS_PER_TASK = 256
FAN_IN = 8

RELEASE_COLUMNS = ["seq", "eff_us", "eff_order", "eff_tie", "overtaken", "proc_block"]
RELEASE_ORDER = ["eff_us", "eff_order", "eff_tie", "overtaken", "seq"]
ENTRY = ["ts", "o", "t"]
FIRST, SEED, WAIT, ROW = range(4)  # what a row of a block's stream is


# ---- blocks of the arrival order -------------------------------------------------------------------

def block_bounds(df: DataFrame, order: str, tie: str, n_blocks: int, n_rows: int) -> list[tuple[int, int]]:
    """Lower bounds of blocks 1..n-1 on ``(order, tie)``; the sample is picked by a hash of the unique ``tie``."""
    if n_blocks == 1:
        return []
    keep = max(1, n_rows // (n_blocks * SAMPLES_PER_BLOCK))
    return _pick_bounds(_sampled(df, order, tie, keep), n_blocks)


def _sampled(df: DataFrame, order: str, tie: str, keep: int) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(F.col(tie)), F.lit(keep)) == 0).select(
        F.col(order).cast("long").alias("o"), F.col(tie).cast("long").alias("t"))


def _pick_bounds(sample: DataFrame, n_blocks: int) -> list[tuple[int, int]]:
    """Evenly spaced entries of the sorted sample; a task sorts and picks for at most ``BOUNDS_PER_TASK`` blocks."""
    tasks = -(-n_blocks // BOUNDS_PER_TASK)
    per_task = -(-n_blocks // tasks)

    def pick(batches):
        pairs = np.concatenate([np.zeros((0, 2), "int64"), *(np.stack([c.to_numpy() for c in b.columns], 1) for b in batches)])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        at = sorted({len(pairs) * i // per_task for i in range(per_task)}) if len(pairs) else []
        yield pa.RecordBatch.from_arrays([pa.array(pairs[at, 0]), pa.array(pairs[at, 1])], names=["o", "t"])

    ranges = sample.repartitionByRange(tasks, "o", "t").mapInArrow(pick, "o long, t long")
    return sorted((r.o, r.t) for r in ranges.collect())[1:]  # the first one is the smallest key of all


def _plan(df: DataFrame, order: str, tie: str, n_blocks: int | None) -> list[tuple[int, int]]:
    """Bounds for blocks of ``ROWS_PER_BLOCK``; rows are counted and sampled in one pass."""
    if n_blocks is not None:
        return block_bounds(df, order, tie, n_blocks, df.count())
    seen = Observation()
    counted = df.select(order, tie).observe(seen, F.count(F.lit(1)).alias("n"))
    sample = stored(_sampled(counted, order, tie, ROWS_PER_BLOCK // SAMPLES_PER_BLOCK), "arrivals")
    blocks = -(-seen.get["n"] // ROWS_PER_BLOCK)
    return _pick_bounds(sample, blocks) if blocks > 1 else []


def _block_of(bounds: list[tuple[int, int]]):
    orders = np.array([b[0] for b in bounds], dtype="int64")
    pair = np.dtype([("o", "int64"), ("t", "int64")])
    pairs = np.array(bounds, dtype=pair)

    def assign(order: np.ndarray, tie: np.ndarray) -> np.ndarray:
        block = np.searchsorted(orders, order, side="right")
        tied = np.flatnonzero(np.searchsorted(orders, order, side="left") != block)
        if len(tied):  # only rows whose order value equals a bound need the tie-break
            keys = np.empty(len(tied), pair)
            keys["o"], keys["t"] = order[tied], tie[tied]
            block[tied] = np.searchsorted(pairs, keys, side="right")
        return block

    return assign


# ---- starting states: a prefix scan of top-k over blocks -------------------------------------------

def _largest(entries: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest entries of every node with their rank ``r``; a partial limit runs before the shuffle."""
    best = Window.partitionBy("node").orderBy(*[F.desc(c) for c in ENTRY])
    return entries.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)


def _block_tops(df: DataFrame, order: str, tie: str, bounds: list, k: int) -> DataFrame:
    """Per input batch and block: the top-k entries, and on the first of them the row count ``n``."""
    assign = _block_of(bounds)

    def shrink(batches):
        for batch in batches:
            ts, o, t = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            node = assign(o, t)
            rank = np.lexsort((-t, -o, -ts, node))
            start = np.flatnonzero(np.diff(node[rank], prepend=-1))
            size = np.diff(np.append(start, len(rank)))
            within = np.arange(len(rank)) - np.repeat(start, size)
            n = np.where(within == 0, np.repeat(size, size), 0)
            at = rank[within < k]
            columns = node[at], n[within < k], ts[at], o[at], t[at]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n", *ENTRY])

    local = df.select(F.unix_micros("timestamp").alias("ts"), F.col(order).cast("long").alias("o"), F.col(tie).cast("long").alias("t"))
    return local.mapInArrow(shrink, "node long, n long, ts long, o long, t long")


def start_states(tops: DataFrame, n_blocks: int, k: int, fan_in: int = FAN_IN) -> DataFrame:
    """``node, ts, o, t, r``: the top-k of all entries in smaller blocks, for every block that has any.

    ``tops`` holds entries (node, ts, o, t) of blocks 0..n-1. Upwards, the states of ``fan_in`` neighbours make the state of
    their parent; downwards, a node starts with what its parent starts with and its smaller siblings hold. Every level is a
    table in the shared folder of at most ``k`` rows per node, and no group has more than ``fan_in * k`` of them.
    """
    sizes, levels = [n_blocks], [stored(_largest(tops.select("node", *ENTRY), k).select("node", *ENTRY), "states")]
    while sizes[-1] > fan_in:
        up = levels[-1].withColumn("node", F.expr(f"node div {fan_in}"))
        levels.append(stored(_largest(up, k).select("node", *ENTRY), "states"))
        sizes.append(-(-sizes[-1] // fan_in))
    seeds = None  # nothing comes before the one root
    for size, states in zip(reversed(sizes), reversed(levels)):
        last = F.least((F.expr(f"node div {fan_in}") + 1) * fan_in, F.lit(size)) - 1
        before = states.where(F.col("node") < last).select(
            F.explode(F.sequence(F.col("node") + 1, last)).alias("node"), *ENTRY)
        if seeds is not None:
            child = F.col("node") * fan_in
            before = before.unionByName(seeds.select(
                F.explode(F.sequence(child, F.least(child + fan_in, F.lit(size)) - 1)).alias("node"), *ENTRY))
        seeds = stored(_largest(before, k), "starts")
    return seeds


def _first_numbers(tops: DataFrame, group: int = 4096) -> DataFrame:
    """``node, first``: the rows in smaller blocks. The only window without a key runs over one row per ``group`` blocks."""
    counts = tops.groupBy("node").agg(F.sum("n").alias("n")).withColumn("g", F.expr(f"node div {group}"))
    in_order = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("g").agg(F.sum("n").alias("n")).select(
        "g", F.coalesce(F.sum("n").over(in_order().orderBy("g")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(in_order("g").orderBy("node")), F.lit(0))
    return counts.withColumn("inside", inside).join(groups, "g").select("node", (F.col("base") + F.col("inside")).alias("first"))


def _heads(tops: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """What a block needs in front of its rows: its first arrival number, its starting state, and for those of its rows that
    are still in the buffer when the next block starts the block in which they leave it."""
    seeds = start_states(tops, n_blocks, k)
    # The smallest entry of a full state has just been released; the others wait, from the block after their own on.
    waits = seeds.where(F.col("r") < k).groupBy(*ENTRY).agg((F.min("node") - 1).alias("node"), F.max("node").alias("value"))
    none = F.lit(None).cast("long")
    first = _first_numbers(tops).select("node", F.lit(FIRST).alias("kind"), *[none.alias(c) for c in ENTRY], F.col("first").alias("value"))
    return first.unionByName(seeds.select("node", F.lit(SEED).alias("kind"), *ENTRY, none.alias("value"))).unionByName(
        waits.select("node", F.lit(WAIT).alias("kind"), *ENTRY, "value"))


# ---- running the buffer ----------------------------------------------------------------------------

class _Buffer:
    """The running top-k of one block as a sorted list. Rows that are no earlier than all before them, most of them, never
    are overtaken: they pass as whole stretches and only the last ``k`` of a stretch enter the list."""

    def __init__(self, k: int, entries: list):
        self.k, self.top = k, sorted(entries)

    def run(self, ts: np.ndarray, o: np.ndarray, t: np.ndarray) -> tuple[list[int], list[tuple]]:
        """Numbers of the overtaken rows and the positions of those that overtook them. Rows come in arrival order."""
        newest = np.maximum.accumulate(np.concatenate([[self.top[-1][0] if self.top else np.iinfo("int64").min], ts]))
        late = np.flatnonzero(ts < newest[:-1]).tolist()
        rows, top, k = list(zip(ts.tolist(), o.tolist(), t.tolist())), self.top, self.k
        at, overtaken, by = 0, [], []
        for i in [*late, len(rows)]:
            if i > at:
                top.extend(rows[max(at, i - k):i])
                del top[:-k]
            at = i + 1
            if i == len(rows):
                break
            if len(top) == k and rows[i] < top[0]:
                overtaken.append(i)
                by.append(top[0])
            else:
                insort(top, rows[i])
                del top[:-k]
        return overtaken, by


def with_processing_order(
    df: DataFrame, k: int = 50, order: str = "arrival_us", tie: str = "event_id", n_blocks: int | None = None
) -> DataFrame:
    """Add the order in which a reorder buffer of size ``k`` releases the rows of ``df``.

    New columns: ``seq`` dense arrival number; ``eff_us, eff_order, eff_tie`` the release position (of a row that was
    overtaken: the position of the row that overtook it); ``overtaken``; and ``proc_block``, a block number that is
    contiguous in release order and holds about as many rows as an arrival block. ``tie`` must be unique. Any ``k`` will do:
    blocks are cut by rows only.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    bounds = _plan(df, order, tie, n_blocks)
    blocks = len(bounds) + 1
    assign = _block_of(bounds)

    def release(batches):
        block, seq, seeds, waits, buffer = 0, 0, [], [], None
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            own = [columns.pop(c) for c in ("_kind", "_value", "_ts", "_block")]
            # Only the block's first row has nulls here; filled, so that 64-bit numbers stay exact.
            kind, value, ts, node, o, t = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in (*own, columns[order], columns[tie]))
            head = int(np.searchsorted(kind, ROW))
            for i in range(head):
                if kind[i] == FIRST:
                    block, seq = int(node[i]), int(value[i])
                elif kind[i] == SEED:
                    seeds.append((int(ts[i]), int(o[i]), int(t[i])))
                else:
                    waits.append((int(t[i]), int(value[i])))
            if head == batch.num_rows:
                continue
            if buffer is None:
                buffer, waits = _Buffer(k, seeds), np.array(sorted(waits), "int64").reshape(-1, 2)
            position = [x[head:].astype("int64") for x in (ts, o, t)]
            rows, by = buffer.run(*position)
            overtaken = np.zeros(len(position[0]), "int64")
            leaves = np.full(len(position[0]), block)
            if len(waits):
                found = np.minimum(np.searchsorted(waits[:, 0], position[2]), len(waits) - 1)
                leaves = np.where(waits[found, 0] == position[2], waits[found, 1], leaves)
            if rows:
                overtaken[rows] = 1
                for column, values in zip(position, np.array(by, "int64").T):
                    column[rows] = values
            added = [np.arange(seq, seq + len(leaves)), *position, overtaken, leaves]
            seq += len(leaves)
            yield pa.RecordBatch.from_arrays(
                [*[c.slice(head) for c in columns.values()], *[pa.array(c, pa.int64()) for c in added]], names=[*columns, *RELEASE_COLUMNS])

    added = [T.StructField(c, T.LongType()) for c in RELEASE_COLUMNS]
    block = F.lit(0)
    if bounds:
        block_udf = F.pandas_udf(lambda o, t: pd.Series(assign(o.to_numpy(), t.to_numpy())), T.LongType())
        block = block_udf(F.col(order), F.col(tie))
    keyed = df.select("*", block.cast("int").alias("_block"), F.lit(ROW).alias("_kind"), F.unix_micros("timestamp").alias("_ts"),
                      F.lit(None).cast("long").alias("_value"))
    if bounds:
        heads = _heads(stored(_block_tops(df, order, tie, bounds, k), "tops"), blocks, k)
        keyed = keyed.unionByName(heads.select(
            F.col("node").cast("int").alias("_block"), F.col("kind").alias("_kind"), F.col("ts").alias("_ts"), F.col("value").alias("_value"),
            F.col("o").cast(df.schema[order].dataType).alias(order), F.col("t").cast(df.schema[tie].dataType).alias(tie)),
            allowMissingColumns=True)
    # At least two partitions: a single one would satisfy every later distribution and keep the rest in one task.
    placed = keyed.repartitionById(max(2, blocks), F.col("_block")).sortWithinPartitions("_kind", order, tie)
    return placed.mapInArrow(release, T.StructType([*df.schema.fields, *added]))


def in_time_order(df: DataFrame, tie: str = "event_id") -> DataFrame:
    """The same columns for rows that are processed in time order, without any shuffle."""
    ts = F.unix_micros("timestamp")
    return df.select(
        "*", F.col(tie).cast("long").alias("seq"), ts.alias("eff_us"), F.lit(0).cast("long").alias("eff_order"),
        F.col(tie).cast("long").alias("eff_tie"), F.lit(0).cast("long").alias("overtaken"),
        F.lit(0).cast("long").alias("proc_block"),
    )


def with_lateness(ordered: DataFrame, lateness_sec: float) -> DataFrame:
    """Class of every released row: the newest time seen at its release is ``eff_us``."""
    if lateness_sec < 0:
        raise ValueError("lateness_sec must not be negative")
    allowed = int(lateness_sec * MICROS)
    behind = F.col("eff_us") - F.unix_micros("timestamp")
    label = F.when(behind <= allowed, "on_time").when(behind <= 2 * allowed, "late_ok").otherwise("late_drop")
    return ordered.withColumn("lateness", label)


def drop_late(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("lateness") != "late_drop")


def lateness_counts(classified: DataFrame) -> DataFrame:
    """Rows and percentage per lateness class."""
    counts = classified.groupBy("lateness").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "lateness", "n", F.round(F.col("n") / F.col("total") * 100, 4).alias("pct"))
