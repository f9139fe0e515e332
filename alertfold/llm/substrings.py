"""Removal of repeated word sequences by difference-cover anchors.

Words are numbered from the start of their document. Those at cover positions modulo ``PERIOD`` begin an anchor of
``window - PERIOD + 1`` words. Differences of cover positions give every residue, so for two equal windows at any places
there is an offset below the period at which both have a cover position: they share an anchor there. Windows around
anchors that occur again are extended to their full length and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from alertfold.llm import repeats as R

# --- fixed values: a perfect difference set, every residue modulo 21 is the difference of two of its members
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
# ---
WINDOW = 35
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of the texts, bounds of the words in the joined bytes, and the number of words per text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    white = _WHITE[data]
    edge = np.diff(np.concatenate([[True], white]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, bounds)]))
    first, second = R.prefixes_of_bytes(data)
    return R.mix(first(start, end - start) ^ (second(start, end - start) << R.U64(1))), start, end, counts


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_words(part) for _, part in R.slices(texts)]
    return (np.concatenate([np.zeros(0, R.U64), *(p[0] for p in parts)]),
            np.concatenate([np.zeros(0, np.int64), *(p[3] for p in parts)]))


def _anchored(window: int):
    size = window - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def find(texts: list[bytes]) -> R.Chunk:
        units, counts = _units(texts)
        ends = np.cumsum(counts)
        starts = ends - counts
        begin = np.repeat(starts, counts)
        places = np.arange(len(units))
        at = np.flatnonzero(in_cover[(places - begin) % PERIOD])
        first = np.maximum(at - PERIOD + 1, begin[at])
        last = np.minimum(np.repeat(ends, counts)[at] - window, at)
        fits = first <= last
        at, first, last = at[fits], first[fits], last[fits]
        one, two = R.prefixes_of_units(units)
        keys = one(at, size)
        checks = R.mix(two(first, last + window - first) + (at - first).astype(R.U64))
        return R.Chunk(window, starts, len(units), [(at, first, last, keys, checks)])

    return find


def _window_hashes(window: int):
    def hashes(texts: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = R.prefixes_of_units(_units(texts)[0])
        return one(places, window), two(places, window)

    return hashes


def _finish(table: pa.Table, texts: list[bytes], starts: np.ndarray, chunk: R.Chunk) -> pa.Table:
    gone, kept, words, removed, at = chunk.covered(starts), [], [], [], 0
    for text in texts:
        found = text.split()
        mask = gone[at:at + len(found)]
        n = int(mask.sum())
        kept.append(b" ".join(found) if not n else b" ".join([w for w, g in zip(found, mask.tolist()) if not g]))
        words.append(len(found))
        removed.append(n)
        at += len(found)
    return pa.table({"id": table.column("id"), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                     "kept": pa.array([k.decode() for k in kept], pa.string())})


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``n_removed`` and ``kept``, the text without the words that lie in a
    ``window``-word sequence that starts anywhere else too, its own document included; kept words are joined by one space.

    All sequences are judged on the input. Words are compared byte by byte through 64-bit hashes, sequences through 128
    bits. Null texts have no words; repeated rows repeat each other; an empty table gives an empty table.
    """
    if window < PERIOD:
        raise ValueError(f"window: at least {PERIOD} words")
    return R.run(docs, text, id_column, _anchored(window), _window_hashes(window), _finish,
                 "n_words long, n_removed long, kept string")
