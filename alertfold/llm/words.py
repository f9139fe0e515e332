"""Token ids of whole texts by way of their distinct words.

In byte-level BPE a match of the splitting pattern starts at every space that a non-space follows, so the ids of a text
are those of its space-cut words put together. Texts in which a space is followed by another white-space character, or
which hold control characters on whose class regex engines differ, are encoded as one piece.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A space before white space or the end; the separators 1C-1F and 85 are white space to some engines only.
_IRREGULAR = r"[\x1c-\x1f\x{85}]| [\x09-\x0d\p{Z}]| \z"


def strings(texts: list[str] | pa.Array) -> pa.Array:
    """Texts as Arrow's strings, nulls as empty ones."""
    return pc.fill_null(texts, "") if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers. ``encode(texts)`` gives the ids of each text as bytes;
    ``encode_words(words)``, if given, those of words with a space before each. Up to ``entries`` words and those of one
    call are kept for later calls; with 0, a call keeps none."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = 600_000,
                 encode_words: Callable[[list[str]], list[bytes]] | None = None):
        self._encode, self._entries, self._known = encode, entries, {}
        self._encode_words = encode_words or (lambda words: encode([" " + w for w in words]))

    def forget(self) -> None:
        self._known = {}

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = strings(texts)
        whole = pc.match_substring_regex(texts, _IRREGULAR)
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")  # a whole text has one empty word here
        words, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy())
        begins = np.append(0, ends)[:-1]
        numbered = words.dictionary_encode()  # by Arrow, so that Python sees only distinct words
        ids = pa.array(self._ids(numbered.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        _, at, data = ids.take(numbered.indices).buffers()
        at, data = np.frombuffer(at, np.int64), memoryview(data or b"")
        first = self._encode(pc.if_else(whole, texts, words.take(pa.array(begins))).to_pylist())  # no space before these
        return [f + data[a:b] for f, a, b in zip(first, at[begins + 1].tolist(), at[ends].tolist())]

    def _ids(self, words: list[str]) -> list[bytes]:
        if not self._entries:
            return self._encode_words(words)
        if len(self._known) > self._entries:
            self._known.clear()
        missing = [w for w in words if w not in self._known]
        self._known.update(zip(missing, self._encode_words(missing)))
        return list(map(self._known.__getitem__, words))
