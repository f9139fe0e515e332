"""Exact search for stretches of ``window`` units that occur more than once in a corpus, without pairing occurrences.

Texts are dealt out in chunks by a hash of their content. A chunk hashes its anchors: places that equal windows share at
equal offsets. An anchor stands for a range of window starts; its block is what those windows cover. A chunk sends each
distinct (anchor hash, block hash) once, packed by hash range, so that an anchor in a third of all texts is one entry per
chunk. The reply tells for each entry whether its whole block occurs again (all its windows are repeated), whether only
the anchor does (its windows are open), or neither. Open windows are settled in a second exchange, together with one copy
of each block that shares their anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from alertfold.llm.common import blocks_for

U64 = np.uint64
REPEATED, OPEN, SHIP, CROWDED = 1, 2, 4, 8
REQUEST = "chunk int, bucket int, keys binary, checks binary, many binary"
REPLY = "chunk int, kind int, bucket int, status binary"
CHUNKS_PER_BLOCK = 4
CROWD = 64  # distinct blocks of an anchor up to which a group is settled in one task
SLICE = 1 << 18  # bytes hashed at once: what a task holds besides its chunk is some twenty arrays of so many numbers
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, (2, 256), U64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(n, SLICE + 1024)
        found = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, base, U64)]))
        if n <= 4 * SLICE:
            _powers[base] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Prefix:
    """Hashes of any stretches of ``units`` (unsigned 64-bit numbers) by prefix sums modulo 2^64."""

    def __init__(self, units: np.ndarray, base: int):
        self.back = _power(pow(base, -1, 1 << 64), len(units) + 1)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(units * _power(base, len(units)))])

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.back[start] + U64(1) * np.asarray(size).astype(U64))


def prefixes_of_bytes(data: np.ndarray) -> tuple[Prefix, Prefix]:
    return Prefix(_BYTE[0][data], _BASES[0]), Prefix(_BYTE[1][data], _BASES[1])


def prefixes_of_units(units: np.ndarray) -> tuple[Prefix, Prefix]:
    return Prefix(units, _BASES[0]), Prefix(mix(units), _BASES[1])


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges from ``start`` up to ``stop``, one range after the other."""
    size = stop - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Chunk:
    """The anchors of a chunk's texts. Units of all texts lie one after another; ``starts`` has where each text begins.

    ``at``, ``first`` and ``last`` are places of the anchors and of their windows' first and last starts. ``entry`` numbers
    the distinct (key, check) pairs in ascending order, ``many`` tells which of them occur more than once here.
    """

    def __init__(self, window: int, starts: np.ndarray, total: int, parts: list[tuple[np.ndarray, ...]]):
        self.window, self.starts, self.total = window, starts, total
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
        self.at, self.first, self.last, keys, checks = (np.concatenate(x) for x in zip(none, *parts))
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        self.entry = np.empty(len(k), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.keys, self.checks = k[new], c[new]
        self.many = np.bincount(self.entry, minlength=len(self.keys)) > 1

    def spread(self, chosen: np.ndarray) -> np.ndarray:
        """A mask over the units: the window starts of the anchors ``chosen``."""
        return self._mask(self.first[chosen], self.last[chosen] + 1)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """A mask over the units: what the windows at ``starts`` (a mask) cover."""
        padded = np.zeros(len(starts) + 2, np.int8)
        padded[1:-1] = starts
        turns = np.flatnonzero(padded[1:] != padded[:-1])  # where runs of window starts begin and end, in turn
        return self._mask(turns[::2], turns[1::2] + self.window - 1)

    def _mask(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A mask over the units: the stretches from ``begin`` up to ``end``, in one array of 32-bit depths."""
        depth = np.zeros(self.total + 1, np.int32)
        np.add.at(depth, begin, 1)
        np.subtract.at(depth, end, 1)
        return np.cumsum(depth, out=depth)[:self.total] > 0


def deal(docs: DataFrame, text: str, id_column: str) -> tuple[DataFrame, int]:
    """(chunk, id, body) by a hash of content and id, and the number of hash ranges. Null texts are empty. The exchange is
    the same plan wherever it is used, so it runs once."""
    blocks = blocks_for(docs, text)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("body", F.col("id").cast("string")), F.lit(blocks * CHUNKS_PER_BLOCK)).cast("int"))
    return rows.repartition(blocks, "chunk").select("chunk", "id", "body"), blocks


def bodies(table: pa.Table) -> list[bytes]:
    return table.column("body").to_pylist()


def slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``SLICE`` bytes, with the number of the first."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= SLICE:
            yield begin, texts[begin:k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def request(chunk: int, keys: np.ndarray, checks: np.ndarray, many: np.ndarray, buckets: int) -> pa.Table:
    """Entries in ascending order, one row per range of keys."""
    bucket = (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
    used, cuts = np.unique(bucket, return_index=True)
    cuts = [*cuts.tolist(), len(keys)]
    pick = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
    return pa.table({"chunk": pa.array([chunk] * len(used), pa.int32()), "bucket": pa.array(used, pa.int32()),
                     "keys": pick(keys), "checks": pick(checks), "many": pick(many.astype(np.uint8))})


def _answer(table: pa.Table, crowd: int) -> pa.Table:
    """The status of every entry of one range of keys."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    keys, checks, many = join("keys", U64), join("checks", U64), join("many", np.uint8)
    sizes = [len(x) for x in table.column("many").to_pylist()]
    sender = np.repeat(table.column("chunk").to_numpy(), sizes)  # rows come in any order; the answer must not depend on it
    order = np.lexsort((sender, checks, keys))
    k, c = keys[order], checks[order]
    new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new[1:] = new_key[1:] | (c[1:] != c[:-1])
    pair, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    often = np.bincount(pair, 1 + many[order].astype(np.int64)) >= 2
    kinds = np.bincount(group[new])  # distinct blocks per anchor
    opened = np.bincount(group[new], ~often) > 0
    status = np.where(often[pair], REPEATED, 0)
    mixed = kinds[group] > 1
    status |= np.where(~often[pair] & mixed, OPEN, 0)
    status |= np.where(new & mixed & opened[group], SHIP, 0)
    status |= np.where(mixed & (kinds[group] > crowd), CROWDED, 0)
    out = np.empty(len(k), np.uint8)
    out[order] = status
    ends = np.cumsum(sizes).tolist()
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([0] * len(ends), pa.int32()), "bucket": table.column("bucket"),
                     "status": pa.array([out[a:b].tobytes() for a, b in zip([0, *ends], ends)], pa.binary())})


def answers(requests: DataFrame, kind: int, crowd: int = CROWD) -> DataFrame:
    found = requests.groupBy("bucket").applyInArrow(lambda table: _answer(table, crowd), REPLY)
    return found if kind == 0 else found.withColumn("kind", F.lit(kind))


def status_of(replies: pa.Table, kind: int) -> np.ndarray:
    """Status of the chunk's entries in ascending order."""
    rows = sorted((b, s) for k, b, s in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "status"))) if k == kind)
    return np.frombuffer(b"".join(s for _, s in rows), np.uint8)


def distinct_windows(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order, the pair of each input, and which pairs occur more than once."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    of = np.empty(len(k), np.int64)
    of[order] = np.cumsum(new) - 1
    return k[new], c[new], of, np.bincount(of, minlength=int(new.sum())) > 1


def run(docs: DataFrame, text: str, id_column: str, anchored: Callable[[list[bytes]], Chunk],
        window_hashes: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]],
        finish: Callable[[pa.Table, list[bytes], np.ndarray, Chunk], pa.Table], schema: str,
        settle: Callable[[DataFrame, int], DataFrame] | None = None,
        blocks_of: Callable[[list[bytes], Chunk, np.ndarray], pa.Table] | None = None, block_schema: str | None = None,
        crowd: int = CROWD) -> DataFrame:
    """The exchanges. ``finish`` gets a chunk's rows, texts, a mask of repeated window starts and its anchors,
    and returns ``id`` and the columns of ``schema``.

    With ``settle`` the open entries of anchors with at most ``crowd`` distinct blocks go to it as rows of ``blocks_of``; it
    returns replies of kind 2. Without it, and for crowded anchors, open windows are counted one by one.
    """
    texts, buckets = deal(docs, text, id_column)
    first_of = lambda table: table.column("chunk")[0].as_py()

    def ask(table: pa.Table) -> pa.Table:
        chunk = anchored(bodies(table))
        return request(first_of(table), chunk.keys, chunk.checks, chunk.many, buckets)

    def by_window(status: np.ndarray) -> np.ndarray:
        """Entries whose windows are counted one by one."""
        asked = (status & (OPEN | SHIP)) > 0
        return asked if settle is None else asked & ((status & CROWDED) > 0)

    def wanted(chunk: Chunk, status: np.ndarray) -> np.ndarray:
        return np.flatnonzero(chunk.spread(one_of_each(chunk, status, by_window(status))))

    def one_of_each(chunk: Chunk, status: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """The anchors of ``entries``; of an entry that occurs again here one is enough, and open ones occur once."""
        chosen = entries[chunk.entry]
        seen = np.zeros(len(chunk.entry), bool)
        seen[np.unique(chunk.entry, return_index=True)[1]] = True
        return chosen & seen

    def ask_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return request(0, np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool), buckets)
        found = bodies(table)
        chunk = anchored(found)
        places = wanted(chunk, status_of(replies, 0))
        keys, checks, _, many = distinct_windows(*window_hashes(found, places))
        return request(first_of(table), keys, checks, many, buckets)

    def ask_blocks(table: pa.Table, replies: pa.Table) -> pa.Table:
        found = bodies(table)
        chunk = anchored(found)
        status = status_of(replies, 0)
        entries = ((status & (OPEN | SHIP)) > 0) & ((status & CROWDED) == 0)
        anchors = np.flatnonzero(one_of_each(chunk, status, entries)) if len(status) else np.zeros(0, np.int64)
        return blocks_of(first_of(table) if table.num_rows else 0, found, chunk, anchors, (status[chunk.entry[anchors]] & OPEN) > 0)

    def conclude(table: pa.Table, replies: pa.Table) -> pa.Table:
        found = bodies(table)
        chunk = anchored(found)
        status = status_of(replies, 0)
        if not len(status):
            return finish(table, found, np.zeros(chunk.total, bool), chunk)
        starts = chunk.spread((status[chunk.entry] & REPEATED) > 0)
        places = wanted(chunk, status)
        if len(places):
            of = distinct_windows(*window_hashes(found, places))[2]
            starts[places[(status_of(replies, 1)[of] & REPEATED) > 0]] = True
        if settle is not None:
            anchor_of = np.full(len(chunk.keys), -1)
            anchor_of[chunk.entry] = np.arange(len(chunk.entry))
            for kind, entry, spans in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "status"))):
                if kind == 2:
                    begin = chunk.first[anchor_of[entry]]
                    for low, high in np.frombuffer(spans, np.int32).reshape(-1, 2).tolist():
                        starts[begin + low:begin + high + 1] = True
        return finish(table, found, starts, chunk)

    by_chunk = texts.groupBy("chunk")
    replies = answers(by_chunk.applyInArrow(ask, REQUEST), 0, crowd)
    more = answers(by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(ask_windows, REQUEST), 1)
    every = replies.unionByName(more)
    if settle is not None:
        blocks = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(ask_blocks, block_schema)
        every = every.unionByName(settle(blocks, buckets))
    out = T.StructType([texts.schema["id"], *T.StructType.fromDDL(schema).fields])
    return by_chunk.cogroup(every.groupBy("chunk")).applyInArrow(conclude, out).withColumnRenamed("id", id_column)
