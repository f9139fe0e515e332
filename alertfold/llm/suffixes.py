"""Removal of repeated byte strings by sorted suffixes.

Of all suffixes only those at anchors are sorted: the place of the smallest hash of ``ANCHOR`` bytes in each window, which
equal windows share. Suffixes with the same anchor form a group. They are put in order by multikey quicksort to a shallow
depth; runs that still agree there have long common prefixes and are ordered by a blind trie, which branches on the first
byte in which two members differ and compares one member in full. Along the order, common prefixes to the right and common
endings to the left of the anchor give the windows that two suffixes share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from alertfold.llm import repeats as R

WINDOW, ANCHOR = 400, 145
SHALLOW = 48
BLOCK = "key long, chunk int, entry long, before int, last int, is_open boolean, body binary"


def common_prefix(a: bytes, b: bytes, begin: int = 0) -> int:
    """Length of the common prefix of ``a`` and ``b``, known to be at least ``begin``."""
    n = min(len(a), len(b))
    if a[begin:n] == b[begin:n]:
        return n
    differing = int.from_bytes(a[begin:n], "big") ^ int.from_bytes(b[begin:n], "big")
    return n - (differing.bit_length() + 7) // 8


class _Blind:
    """A blind trie: inner nodes are [depth, {byte: child}], leaves are member numbers. A byte of -1 is the end."""

    def __init__(self, texts: list[bytes], members: list[int]):
        self.texts, self.root = texts, members[0]
        for m in members[1:]:
            self._insert(m)

    def _byte(self, m: int, depth: int) -> int:
        text = self.texts[m]
        return text[depth] if depth < len(text) else -1

    def _insert(self, m: int) -> None:
        node, path = self.root, []
        while isinstance(node, list):  # blind: only branching bytes are looked at, a missing one takes any child
            path.append(node)
            child = node[1].get(self._byte(m, node[0]))
            node = next(iter(node[1].values())) if child is None else child
        depth = common_prefix(self.texts[m], self.texts[node])
        own, other = self._byte(m, depth), self._byte(node, depth)
        above = None
        for inner in path:
            if inner[0] >= depth:
                break
            above = inner
        if own == other:  # equal texts end together: kept as further members of one leaf
            own = (-1, m)
        inside = self.root if above is None else above[1][self._byte(m, above[0])]
        if isinstance(inside, list) and inside[0] == depth:
            inside[1][own] = m
            return
        grown = [depth, {other: inside, own: m}]
        if above is None:
            self.root = grown
        else:
            above[1][self._byte(m, above[0])] = grown

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                rank = lambda b: (b, 0) if isinstance(b, int) else b
                stack.extend(node[1][b] for b in sorted(node[1], key=rank, reverse=True))
            else:
                out.append(node)
        return out


def deep_shallow(texts: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """The order of ``texts``, which agree in their first ``depth`` bytes: multikey quicksort for ``shallow`` bytes, then
    blind tries."""
    out: list[int] = []
    stack = [(list(range(len(texts))), depth)]
    while stack:
        members, at = stack.pop()
        if len(members) == 1:
            out.append(members[0])
            continue
        if at >= depth + shallow:
            out.extend(_Blind(texts, members).ordered())
            continue
        word = [texts[m][at:at + 8] for m in members]
        pivot = sorted((word[0], word[len(word) // 2], word[-1]))[1]
        less = [m for m, w in zip(members, word) if w < pivot]
        same = [m for m, w in zip(members, word) if w == pivot]
        more = [m for m, w in zip(members, word) if w > pivot]
        if more:
            stack.append((more, at))
        stack.append((same, at + 8) if len(pivot) == 8 else (same, depth + shallow))
        if less:
            stack.append((less, at))
    return out


def shared_windows(members: list[tuple[int, int, bool, bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each open member of a group, the ranges of its window starts (from the block's first) that another has too.

    A member is (bytes before the anchor, its last window start, open, block).
    """
    right = [body[before:] for before, _, _, body in members]
    left = [body[:before][::-1] for before, _, _, body in members]
    order = deep_shallow(right)
    step = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:])]
    found: list[list[tuple[int, int]]] = [[] for _ in members]
    for rank, m in enumerate(order):
        before, last, is_open, _ = members[m]
        if not is_open:
            continue
        spans = []
        for way in (1, -1):
            reach, at = len(right[m]), rank
            while 0 <= at + way < len(order):
                reach = min(reach, step[at if way == 1 else at - 1])
                at += way
                if reach < window - before:  # even with all bytes before the anchor too short
                    break
                back = common_prefix(left[m], left[order[at]])
                low, high = before - back, min(before - (window - reach), last)
                if low <= high:
                    spans.append((low, high))
                    if low == 0 and high == last:
                        break
        found[m] = spans
    return found


def _anchored(window: int):
    width = window - ANCHOR + 1  # a power of two: hashes that a window chooses from

    def of_slice(texts: list[bytes], base: int) -> tuple[np.ndarray, ...]:
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data) - window + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none.view(R.U64), none.view(R.U64)
        one, two = R.prefixes_of_bytes(data)
        places = np.arange(len(data) - ANCHOR + 1)
        hashes = one(places, ANCHOR)
        least = (hashes & ~R.U64(0xFFFFFFFF)) | places.astype(R.U64)  # equal hashes: the leftmost
        step = 1
        while step < width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        starts = np.concatenate([np.arange(e - size, e - window + 1) for e, size in zip(ends, lengths) if size >= window]
                                or [np.zeros(0, np.int64)])
        at = (least[starts] & R.U64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        first, last, at = starts[begin], starts[np.append(begin[1:], len(at)) - 1] if len(at) else starts, at[begin]
        checks = R.mix(two(first, last + window - first) + (at - first).astype(R.U64))
        # The smallest hashes of windows all lie in the lowest range; mixed again, one to one, they fill all ranges alike.
        return at + base, first + base, last + base, R.mix(hashes[at]), checks

    def find(texts: list[bytes]) -> R.Chunk:
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        parts = [of_slice(part, int(starts[k])) for k, part in R.slices(texts)]
        return R.Chunk(window, starts, int(ends[-1]) if len(texts) else 0, parts)

    return find


def _window_hashes(window: int):
    def hashes(texts: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, base = [(np.zeros(0, R.U64), np.zeros(0, R.U64))], 0
        for _, part in R.slices(texts):
            data = np.frombuffer(b"".join(part), np.uint8)
            mine = places[np.searchsorted(places, base):np.searchsorted(places, base + len(data))] - base
            if len(mine):
                one, two = R.prefixes_of_bytes(data)
                out.append((one(mine, window), two(mine, window)))
            base += len(data)
        return tuple(np.concatenate(x) for x in zip(*out))

    return hashes


def _blocks_of(window: int):
    def blocks(chunk_id: int, texts: list[bytes], chunk: R.Chunk, anchors: np.ndarray, is_open: np.ndarray) -> pa.Table:
        data = b"".join(texts)
        first, last, at = chunk.first[anchors], chunk.last[anchors], chunk.at[anchors]
        entries = chunk.entry[anchors]
        return pa.table({
            "key": pa.array(chunk.keys[entries].view(np.int64)), "chunk": pa.array(np.full(len(anchors), chunk_id, np.int32)),
            "entry": pa.array(entries), "before": pa.array((at - first).astype(np.int32)),
            "last": pa.array((last - first).astype(np.int32)), "is_open": pa.array(is_open),
            "body": pa.array([data[a:b] for a, b in zip(first.tolist(), (last + window).tolist())], pa.binary())})

    return blocks


def _settle(window: int):
    """Groups by anchor, none of more than ``CROWD`` distinct blocks, settled as sorted runs of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: list[tuple]) -> list[tuple]:
            out = []
            for (_, chunk, entry, *_), spans in zip(rows, shared_windows([r[3:] for r in rows], window)):
                if spans:
                    out.append((chunk, entry, np.array(spans, np.int32).tobytes()))
            return out

        def as_batch(out: list[tuple]) -> pa.RecordBatch:
            chunk, entry, spans = zip(*out)
            return pa.RecordBatch.from_arrays([
                pa.array(chunk, pa.int32()), pa.array([2] * len(out), pa.int32()), pa.array(entry, pa.int32()),
                pa.array(spans, pa.binary())], ["chunk", "kind", "bucket", "status"])

        group: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    out += settled(group)
                    group = []
                group.append(row)
            if len(out) >= 4096:
                yield as_batch(out)
                out = []
        if group:
            out += settled(group)
        if out:
            yield as_batch(out)

    return lambda blocks, buckets: blocks.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(run, R.REPLY)


def _finish(table: pa.Table, texts: list[bytes], starts: np.ndarray, chunk: R.Chunk) -> pa.Table:
    gone, kept, removed, spans, at = chunk.covered(starts), [], [], [], 0
    for text in texts:
        mask = gone[at:at + len(text)]
        n = int(mask.sum())
        kept.append(text if not n else np.frombuffer(text, np.uint8)[~mask].tobytes())
        removed.append(n)
        spans.append(int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0)
        at += len(text)
    numbers = lambda x: pa.array(x, pa.int64())
    return pa.table({"id": table.column("id"), "n_bytes": numbers([len(t) for t in texts]), "n_removed": numbers(removed),
                     "n_spans": numbers(spans), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", window: int = WINDOW,
                   crowd: int = R.CROWD) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, the
    UTF-8 bytes of its text without those that lie in a ``window``-byte string that starts anywhere else too.

    ``window - 144`` must be a power of two. All strings are judged on the input; matches don't cross documents, but may
    overlap within one. ``kept`` may cut a character. Null texts are empty; repeated rows repeat each other; an empty table
    gives an empty table. Groups of an anchor with more than ``crowd`` distinct blocks are not gathered: their windows
    are counted one by one, with the same result.
    """
    if window <= ANCHOR or (window - ANCHOR + 1) & (window - ANCHOR):
        raise ValueError("window - 144 must be a power of two")
    return R.run(docs, text, id_column, _anchored(window), _window_hashes(window), _finish,
                 "n_bytes long, n_removed long, n_spans long, kept binary",
                 _settle(window), _blocks_of(window), BLOCK, crowd)
