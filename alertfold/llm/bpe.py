"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece of text (one match of the splitting pattern) is a row of byte positions. Leaf ``i`` of its segment tree holds the
rank of the pair that starts at position ``i`` together with ``i``, so that the root is the leftmost pair of minimum rank.
A merge changes three leaves: the right half leaves the list of live positions, and the pairs to both sides get new
ranks. Each change is a walk from leaf to root. Short pieces are merged many at a time as rows of arrays.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from alertfold.llm.words import WordEncoder

_NONE = np.int64(1) << 60
_TOGETHER = 256  # pieces up to so many bytes are merged as rows of arrays


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file if line.strip())}


class SegmentTreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.findall = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.whole, self.pieces = ranks, {}
        pairs = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of 2 to ``width`` bytes, ``width`` a power of two: one tree per row."""
        rows, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        places = np.arange(width)
        live = places < lengths[:, None]
        ids = np.zeros((rows, width + 1), np.int64)  # the last column takes writes beyond the ends
        ids[:, :width] = self.byte_id[raw]
        after = np.minimum(places + 1, width) + np.zeros((rows, 1), np.int64)
        after[places[None, :] + 1 >= lengths[:, None]] = width
        before = np.hstack([places - 1 + np.zeros((rows, 1), np.int64), np.zeros((rows, 1), np.int64)])
        before[:, 0] = width
        tree = np.full((rows, 2 * width), _NONE)
        first = np.where(after < width, self._ranks_of(ids[:, :width], np.roll(ids[:, :width], -1, 1)), _NONE)
        tree[:, width:] = np.where(first < _NONE, first * width + places, _NONE)
        for level in range(width.bit_length() - 2, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low:2 * high:2], tree[:, 2 * low + 1:2 * high:2])

        def put(r: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[r, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def rate(r: np.ndarray, at: np.ndarray) -> None:
            right = after[r, at]
            rank = self._ranks_of(ids[r, at], ids[r, right])
            put(r, at, np.where((right < width) & (rank < _NONE), rank * width + at, _NONE))

        r = np.flatnonzero(tree[:, 1] < _NONE)
        while len(r):
            key = tree[r, 1]
            at = key % width
            gone = after[r, at]
            ids[r, at] = key // width
            live[r, gone] = False
            beyond = after[r, gone]
            after[r, at] = beyond
            before[r, beyond] = at
            put(r, gone, np.full(len(r), _NONE))
            rate(r, at)
            left = before[r, at]
            some = left < width
            if some.any():
                rate(r[some], left[some])
            r = r[tree[r, 1] < _NONE]
        flat, ends = ids[:, :width][live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_long(self, piece: bytes) -> bytes:
        """The same for one long piece, on lists."""
        n = len(piece)
        width, none = 1 << (n - 1).bit_length(), int(_NONE)
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before, pairs = [*range(1, n), -1], [*range(-1, n - 1)], self.pairs
        tree = [none] * (2 * width)

        def rank_at(i: int) -> int:
            rank = pairs.get(ids[i] << 32 | ids[after[i]]) if after[i] >= 0 else None
            return none if rank is None else rank * width + i

        tree[width:width + n] = map(rank_at, range(n))
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    return
                tree[node] = value

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            put(gone, none)
            put(i, rank_at(i))
            if before[i] >= 0:
                put(before[i], rank_at(before[i]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        done: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            rank = self.whole.get(piece)
            if rank is not None:
                done[k] = rank.to_bytes(4, "little")
            elif len(piece) > _TOGETHER:
                done[k] = self._merge_long(piece)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for width, members in by_width.items():
            for k, ids in zip(members, self._merge_rows([pieces[k] for k in members], width)):
                done[k] = ids
        return done

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without special tokens."""
        if len(self.pieces) > 300_000:
            self.pieces.clear()
        split = list(map(self.findall, texts))
        missing = list(set().union(*split) - self.pieces.keys())
        self.pieces.update(zip(missing, self._merge([m.encode() for m in missing])))
        known = self.pieces.__getitem__
        return [b"".join(map(known, s)) for s in split]


@cache
def _encoder(path: str, pattern: str) -> WordEncoder:
    return WordEncoder(SegmentTreeBpe(read_ranks(path), pattern).encode)


@cache
def _words_of(path: str) -> dict[int, bytes]:
    return {rank: word for word, rank in read_ranks(path).items()}


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``: the token ids of ``text``, packed as little-endian unsigned 32-bit integers.

    ``ranks_path`` is read on the executors. No shuffle; memory is bounded by a batch of rows and by the dictionary of
    known words. A null or empty text has no ids; repeated rows each give a row; an empty table gives an empty table.
    """
    docs = docs.select(*keep, text)
    fields = [docs.schema[name] for name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                ids = encoder([t or "" for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(ids, pa.binary())], [*keep, "ids"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` in ``into``, a binary column; null ids decode to null."""
    schema, names = encoded.schema, encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = _words_of(ranks_path).__getitem__
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                out = [None if x is None else b"".join(map(word, np.frombuffer(x, "<u4").tolist()))
                       for x in part.column(names.index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*names, into])

    return encoded.mapInArrow(run, T.StructType([*schema.fields, T.StructField(into, T.BinaryType())]))
