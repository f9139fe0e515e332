"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are put in tiles by their population count; a tile of more than ``TILE`` members is split by hash.
Two fingerprints that differ in at most ``radius`` bits have population counts that differ by at most ``radius``, so
only tile pairs within that distance meet. Inside a tile pair the same bound holds for the counts of the four 16-bit
quarters: their differences add up to at most ``radius``. What passes is compared with exclusive-or and bit counts. A
tile pair gives a spanning forest of its links, never all of them, and the forests are joined to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from alertfold.llm.common import free_name, stored
from alertfold.llm.components import components

TILE = 1 << 16
_PAIRS_AT_ONCE = 1 << 22
SKETCH, SHARED = 16, 3  # smallest shingle hashes that a node carries, and how many of them near copies have in common
_PAD, _SKETCHES_AT_ONCE = 0xFFFFFFFF, 1 << 14
BLOCK = 1 << 21  # shingles of a block of texts that are compared in one task
_NODE_WEIGHT = 32  # shingles that a text counts for besides its own, so that a block has at most BLOCK / 32 texts
_VALUES_AT_ONCE = 1 << 21
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8) * 256


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the XXH64 values of the text's shingles of ``words`` words, repeats
    included. A shorter text is one shingle; one without words has fingerprint 0. Only A-Z are lower-cased."""
    values = _shingles(text, words, seed)[1]
    if not values:
        return 0
    return _votes(values)


def _shingles(text: str, words: int, seed: int) -> tuple[bytes, list[int]]:
    """The words of ``text`` with one space between them, and the XXH64 values of their shingles."""
    found = text.encode().translate(_LOWER).split()
    body = b" ".join(found)
    if not found:
        return body, []
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    hashed = xxhash.xxh64_intdigest
    return body, [hashed(body[a:b - 1], seed) for a, b in zip(starts, ends[words - 1:] or ends[-1:])]


def _votes(values: list[int]) -> int:
    bytes_ = np.array(values, "<u8").view(np.uint8).reshape(-1, 8)
    votes = np.bincount((bytes_ + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * votes.ravel() > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 4) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint of ``text`` as a signed 64-bit number. Null texts have no words."""
    docs = docs.select(*keep, text)
    schema = T.StructType([*(docs.schema[name] for name in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t or "", words) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(np.array(values, "<u8").view("<i8"))], [*keep, "fp"])

    return docs.mapInArrow(run, schema)


def _root(label: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = label[at]
    while True:
        above = label[found]
        if (above == found).all():
            return found
        found = above


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _root(label, a), _root(label, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _quarters(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that join what is within ``radius`` bits between two tiles of unsigned 64-bit numbers."""
    codes, groups, members = [], [], []
    for values in (left, right):
        kinds, of = np.unique(_quarters(values), axis=0, return_inverse=True)
        codes.append(kinds)
        groups.append(of.ravel())
    members = np.argsort(groups[0], kind="stable")
    bounds = np.searchsorted(groups[0][members], np.arange(len(codes[0]) + 1))
    label = np.arange(len(left) + len(right))
    for k, code in enumerate(codes[0]):
        near = np.abs(codes[1] - code).sum(1) <= radius
        if not near.any():
            continue
        mine, theirs = members[bounds[k]:bounds[k + 1]], np.flatnonzero(near[groups[1]])
        step = max(1, _PAIRS_AT_ONCE // len(theirs))
        for at in range(0, len(mine), step):
            rows = mine[at:at + step]
            r, c = np.nonzero(np.bitwise_count(left[rows][:, None] ^ right[theirs][None, :]) <= radius)
            _unite(label, rows[r], len(left) + theirs[c])
    values = np.concatenate([left, right])
    at = np.flatnonzero(label != np.arange(len(label)))
    return values[at], values[_root(label, at)]


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) that span the components of the distinct values of ``fp``; at most two per value and tile pair."""
    ones = F.bit_count("fp").cast("int")
    sizes = {r["p"]: r["n"] for r in distinct.groupBy(ones.alias("p")).agg(F.count("*").alias("n")).collect()}  # 65 rows
    slots = [-(-sizes.get(p, 0) // tile) for p in range(65)]
    slots_of = lambda p: F.get(F.array(*map(F.lit, slots)), p)
    tiles = (distinct.select("fp", ones.alias("p"))
             .select("fp", "p", F.pmod(F.xxhash64("fp"), F.greatest(slots_of(F.col("p")), F.lit(1))).cast("int").alias("i"))
             .groupBy("p", "i").agg(F.collect_list("fp").alias("fps")))
    partners = F.flatten(F.transform(
        F.sequence("p", F.least(F.col("p") + radius, F.lit(64))),
        lambda q: F.when(slots_of(q) > 0, F.transform(
            F.sequence(F.lit(0), slots_of(q) - 1), lambda j: F.struct(q.alias("q"), j.alias("j")))).otherwise(
                F.array().cast("array<struct<q:int,j:int>>"))))
    left = tiles.select("p", "i", F.col("fps").alias("left_fps"), F.explode(partners).alias("to")).select(
        "p", "i", "left_fps", "to.q", "to.j").where("q > p OR j >= i")
    right = tiles.select(F.col("p").alias("q"), F.col("i").alias("j"), F.col("fps").alias("right_fps"))
    met = left.join(right, ["q", "j"]).select("left_fps", "right_fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsigned = lambda x: x.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for batch in batches:
            for k in range(batch.num_rows):
                u, v = forest(unsigned(batch.column(0)[k]), unsigned(batch.column(1)[k]), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return met.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` and ``component_id``, the smallest id that links of at most ``radius``
    differing bits reach. Null texts are texts without words (fingerprint 0); null ids are ignored in the minimum, which
    is null where a component has no other; repeated rows stay repeated; an empty table gives an empty table.
    """
    fps = stored(fingerprints(docs, text, (id_column,), words), "fingerprints")
    first = fps.groupBy("fp").agg(F.min(id_column).alias("first"))
    roots = components(links(first, radius))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(id_column, "fp", "component_id")


def _sketch(values: list[int]) -> bytes:
    """The ``SKETCH`` smallest different upper halves of hash values, as unsigned 32-bit integers; ``_PAD`` fills it up."""
    least = np.unique(np.minimum(np.array(values, np.uint64) >> np.uint64(32), _PAD - 1).astype(np.uint32))[:SKETCH]
    return np.concatenate([least, np.full(SKETCH - len(least), _PAD, np.uint32)]).tobytes()


def _nodes(numbered: DataFrame, order: str, text: str, words: int) -> DataFrame:
    """One row per different word sequence of ``numbered``: ``first``, the smallest ``order`` that has it, ``node``, the
    row number in there, the fingerprint ``fp``, ``n``, how many different shingles it has, and their ``sketch``."""
    docs = numbered.select(F.col(order).alias("first"), text)
    schema = T.StructType([docs.schema["first"], *T.StructType.fromDDL("digest binary, fp long, n int, sketch binary").fields])

    def node_of(value: str | None) -> tuple[bytes, int, int, bytes]:  # a text's hashes go before the next one's are made
        body, values = _shingles(value or "", words, 42)
        return xxhash.xxh3_128_digest(body), _votes(values) if values else 0, len(set(values)), _sketch(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [node_of(value.as_py()) for value in batch.column(1)]
            columns = zip(*found) if found else [()] * 4
            kinds = (pa.binary(), pa.uint64(), pa.int32(), pa.binary())
            digest, fp, n, sketch = (pa.array(c, kind) for c, kind in zip(columns, kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), digest, fp.view(pa.int64()), n, sketch], schema.fieldNames())

    return docs.mapInArrow(run, schema).groupBy("digest", "fp", "n", "sketch").agg(F.min("first").alias("first")).select(
        F.col("first.row").alias("node"), "fp", "n", "sketch", "first")


def _span(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unites the ends of the pairs (a, b) in ``label``; positions of pairs that span what is new, early ones first."""
    taken, left = [], np.arange(len(a))
    while True:
        x, y = _root(label, a[left]), _root(label, b[left])
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate(taken) if taken else left
        high, at = np.unique(np.maximum(x, y), return_index=True)
        label[high] = np.minimum(x, y)[at]
        taken.append(left[at])


@dataclass
class Tile:
    """Nodes of a tile in the order of their shingle counts."""
    node: np.ndarray
    fp: np.ndarray
    n: np.ndarray
    sketch: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.n, kind="stable")
        self.node, self.fp, self.n, self.sketch = (x[order] for x in (self.node, self.fp, self.n, self.sketch))


def _alike(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the sketches ``a`` and ``b`` of each pair share at least ``least`` values."""
    found = np.empty(len(a), bool)
    for at in range(0, len(a), _SKETCHES_AT_ONCE):
        x, y = a[at:at + _SKETCHES_AT_ONCE], b[at:at + _SKETCHES_AT_ONCE]
        shared = ((x[:, :, None] == y[:, None, :]) & (x != _PAD)[:, :, None]).sum((1, 2))
        found[at:at + _SKETCHES_AT_ONCE] = shared >= least[at:at + _SKETCHES_AT_ONCE]
    return found


def near_pairs(left: Tile, right: Tile, same: bool, radius: int, share: float) -> Iterator[tuple]:
    """Pairs of nodes that span all pairs of two tiles that differ in at most ``radius`` bits, whose shingle counts allow a
    Jaccard similarity of ``share`` and whose sketches don't speak against it. ``same``: both tiles are one."""
    label = np.arange(len(left.n) + (0 if same else len(right.n)))
    offset, at = 0 if same else len(left.n), 0
    while at < len(left.n):
        least = np.searchsorted(right.n, np.ceil(share * left.n[at] - 1e-9))
        step = max(1, _PAIRS_AT_ONCE // max(1, len(right.n) - least))
        rows = slice(at, at + step)
        most = np.searchsorted(right.n, np.floor(left.n[rows][-1] / share + 1e-9), side="right")
        bits = np.bitwise_count(left.fp[rows].view(np.uint64)[:, None] ^ right.fp[least:most].view(np.uint64)[None, :])
        r, c = np.nonzero(bits <= radius)
        r, c = at + r, least + c
        small, large = np.minimum(left.n[r], right.n[c]), np.maximum(left.n[r], right.n[c])
        fit = (small >= share * large - 1e-9) & (_root(label, r) != _root(label, offset + c))
        if same:
            fit &= left.node[r] < right.node[c]
        r, c, small = r[fit], c[fit], small[fit]
        fit = _alike(left.sketch[r], right.sketch[c], np.minimum(small, SHARED))
        r, c = r[fit], c[fit]
        spanning = _span(label, r, offset + c)
        yield left.node[r[spanning]], right.node[c[spanning]]
        at += step


def _candidates(nodes: DataFrame, radius: int, share: float, tile: int) -> DataFrame:
    """Pairs (u, v) of :func:`near_pairs` over all tiles. A tile holds nodes of one size class; the shingle counts of
    neighbouring classes differ by the factor ``share``, so that only a class and the next one meet."""
    nodes = nodes.where("n > 0").withColumn("p", F.floor(F.log("n") / math.log(1 / share)).cast("int"))
    sizes = {r["p"]: r["size"] for r in nodes.groupBy("p").agg(F.count("*").alias("size")).collect()}  # one row per class
    slots = [-(-sizes.get(p, 0) // tile) for p in range(max(sizes, default=0) + 2)]
    slots_of = lambda p: F.get(F.array(*map(F.lit, slots)), p)
    columns = ("node", "fp", "n", "sketch")
    tiles = (nodes.select(*columns, "p", F.pmod(F.xxhash64("node"), slots_of(F.col("p"))).cast("int").alias("i"))
             .groupBy("p", "i").agg(F.collect_list(F.struct(*columns)).alias("rows")))
    partners = F.flatten(F.transform(F.array(F.col("p"), F.col("p") + 1), lambda q: F.when(slots_of(q) > 0, F.transform(
        F.sequence(F.lit(0), slots_of(q) - 1), lambda j: F.struct(q.alias("q"), j.alias("j")))).otherwise(
            F.array().cast("array<struct<q:int,j:int>>"))))
    mine = tiles.select("p", "i", F.col("rows").alias("mine"), F.explode(partners).alias("to")).select(
        "p", "i", "mine", "to.q", "to.j").where("q > p OR j >= i")
    theirs = tiles.select(F.col("p").alias("q"), F.col("i").alias("j"), F.col("rows").alias("theirs"))
    met = mine.join(theirs, ["q", "j"]).select("mine", "theirs", F.expr("p = q AND i = j").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(rows: pa.ListScalar) -> Tile:
            node, fp, n, sketch = rows.values.flatten()
            values = np.frombuffer(b"".join(sketch.to_pylist()), np.uint32).reshape(-1, SKETCH)
            return Tile(*(x.to_numpy(zero_copy_only=False) for x in (node, fp, n)), values)

        for batch in batches:
            for k in range(batch.num_rows):
                sides = side(batch.column(0)[k]), side(batch.column(1)[k])
                for u, v in near_pairs(*sides, batch.column(2)[k].as_py(), radius, share):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return met.mapInArrow(run, "u long, v long")


class Sets:
    """Sets of hash values that are numbered together, in the order in which they were given."""

    def __init__(self, sets: list[np.ndarray]):
        values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.numbers, self.seen = numbers.astype(np.int32), np.zeros(len(values), bool)
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.start = np.cumsum(self.size) - self.size

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """How many values the set ``one`` shares with each of ``others``; no set is empty."""
        mine = self.numbers[self.start[one]:self.start[one] + self.size[one]]
        self.seen[mine] = True
        size = self.size[others]
        ends = np.cumsum(size)
        at = np.repeat(self.start[others] - ends + size, size) + np.arange(ends[-1])
        found = np.add.reduceat(self.seen[self.numbers[at]].view(np.uint8), ends - size, dtype=np.int64)
        self.seen[mine] = False
        return found


def similar(sets: Sets, fp: np.ndarray, block: np.ndarray, radius: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (u, v) of links that span all links between two blocks, or in one if all of ``block`` are equal: pairs
    within ``radius`` bits with a Jaccard similarity of at least ``share``."""
    label, found = np.arange(len(fp)), []
    across = block[0] != block[-1]
    prints = fp.view(np.uint64)
    for u in range(len(fp)):
        v = np.flatnonzero(np.bitwise_count(prints[u + 1:] ^ prints[u]) <= radius) + u + 1
        if across:
            v = v[block[v] != block[u]]
        v = v[np.minimum(sets.size[v], sets.size[u]) >= share * np.maximum(sets.size[v], sets.size[u]) - 1e-9]
        if len(v):
            v = v[_root(label, v) != _root(label, np.array([u]))]
        while len(v):  # a bounded number of values at a time; what one part links needs no test in the next
            part = v[:max(1, int(np.searchsorted(np.cumsum(sets.size[v]), _VALUES_AT_ONCE)))]
            both = sets.shared(u, part)
            near = part[both >= share * (sets.size[part] + sets.size[u] - both) - 1e-9]
            near = near[_span(label, np.full(len(near), u), near)]
            found.append((np.full(len(near), u), near))
            v = v[len(part):]
            v = v[_root(label, v) != _root(label, np.array([u]))]
    if not found:
        return label[:0], label[:0]
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal ``keys`` of sorted batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(values[:, a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _confirmed(nodes: DataFrame, groups: DataFrame, texts: DataFrame, words: int, radius: int, share: float,
               block: int) -> DataFrame:
    """Links (u, v) that span all pairs of a group of ``groups`` (node, root) within ``radius`` bits with a Jaccard
    similarity of at least ``share``.

    A group is dealt out to blocks of about ``block`` shingles, and every two of its blocks meet in one task. A text
    travels once per pair of blocks that it is in, which is once in all for a group of one block, and never with a pair.
    """
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).join(
        nodes.select("node", "fp", "n"), "node")
    sizes = members.groupBy("root").agg(F.ceil(F.sum(F.col("n") + _NODE_WEIGHT) / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").select(
        "node", "root", "fp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    met = texts.join(dealt, "node").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "node", "root", "fp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "text")
    keys = ["root", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, keys):
            sets = Sets([np.unique(np.array(_shingles(t, words, 42)[1], np.uint64)) for t in rows.column("text").to_pylist()])
            node, fp, blocks = (rows.column(c).to_numpy() for c in ("node", "fp", "block"))
            u, v = similar(sets, fp, blocks, radius, share)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return met.repartition(*keys).sortWithinPartitions(*keys, "block", "node").mapInArrow(run, "u long, v long")


def keep_one_similar(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 5, radius: int = 18,
                     share: float = 0.8, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row, chosen as in :func:`keep_one`, of each group that links join. A link needs at most ``radius``
    differing bits and a Jaccard similarity of the sets of shingles of ``words`` words of at least ``share``, which is
    computed on the 64-bit hashes of all shingles; texts with equal words, or with none, are copies.

    Tiles of fingerprints give the pairs that span all candidates: within ``radius`` bits, of fitting sizes, and with at
    least ``SHARED`` of the ``SKETCH`` smallest shingle hashes in common, which a pair of similarity 0.8 misses once in
    10**8. So texts that are near by chance alone don't meet, and the radius can be one that hardly loses a link. The groups
    of candidates are then compared in blocks that fit a task. A group of any size, linked or not, leaves at most one row
    per member and pair of blocks; no pair is a row.
    """
    row = free_name(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    order = free_name(numbered, "order")
    ordered = numbered.withColumn(
        order, F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col(row).alias("row")))
    nodes = stored(_nodes(ordered, order, text, words), "nodes")
    texts = numbered.select(F.col(row).alias("node"), F.col(text).alias("text"))
    groups = components(_candidates(nodes, radius, share, tile))
    roots = components(_confirmed(nodes, groups, texts, words, radius, share, block))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)


def keep_one(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`: that with the smallest id (ids come before null,
    equal ids in the order of the stored table). All columns stay as they are."""
    row = free_name(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    order = free_name(numbered, "order")
    found = near_duplicates(
        numbered.withColumn(order, F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col(row).alias("row"))),
        text, order, words, radius)
    kept = found.where(F.col(order) == F.col("component_id")).select(F.col(f"{order}.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
