"""Lexical retrieval packing: documents that share words are put into the same training sequence.

Documents are taken in shards of bounded size. A shard has a BM25 inverted index of its own; the first document of a
window is the seed, the index ranks the shard's unused documents for it, and these fill the window in turn. A document
that is longer than what is left of the window is cut: its rest opens the next window and is the seed there. What is left
open at the end of a shard goes on with the next one, so that only the last window of a partition can be incomplete;
that one is dealt out to sequences whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from alertfold.llm.words import WordEncoder, strings

WINDOW = 2048
SHARD_DOCS, SHARD_CHARS = 512, 16 << 20
WORDS_TOGETHER = 2048
ENCODE_CHARS = 8 << 20  # texts encoded together: the more, the fewer words are encoded again
PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_RUNS, _RUN = r"|\s+(?!\S)|\s+", re.compile(r"\s\s")  # how the pattern ends; a run of white space


@cache
def _encoder(path: str) -> WordEncoder:
    """An encoder with the ids of the tokenizer file at ``path``, a byte-level BPE without normaliser whose ids follow the
    order of its merges; it knows no added tokens."""
    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # the file writes bytes as printable characters: those of Latin-1 that print as themselves, the others from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in word): rank for word, rank in model["vocab"].items()}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(model["vocab"][word] != 256 + k for k, word in enumerate(merged)):
        raise ValueError(f"{path}: its ids don't follow its merges")
    by = lambda pattern: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # white space that stands alone needs no looking ahead, which takes much of the pattern's time
    encode = by(public_tokenizers.PATTERN)
    encode_single = by(public_tokenizers.PATTERN.removesuffix(_RUNS) + r"|\s") if public_tokenizers.PATTERN.endswith(_RUNS) else encode
    opens = np.zeros(max(ranks.values()) + 1, bool)  # ids that begin with a space: in a row of words, where a word begins
    opens[[rank for word, rank in ranks.items() if word[0] == 32]] = True
    each = lambda texts: [array("I", encode(t)).tobytes() for t in texts]

    def words_together(words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), WORDS_TOGETHER):
            part = words[at:at + WORDS_TOGETHER]
            row = " " + " ".join(part)
            ids = np.array((encode if _RUN.search(row) else encode_single)(row), np.uint32)
            cuts, data = (4 * np.append(np.flatnonzero(opens[ids]), len(ids))).tolist(), ids.tobytes()
            whole = len(cuts) == len(part) + 1
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])] if whole else each([" " + w for w in part])
        return out

    return WordEncoder(each, entries=0, encode_words=words_together)


@cache
def _added(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """What finds the added tokens of the tokenizer file at ``path`` in a text, and their ids as bytes."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{path}: added tokens that look at their neighbours are not supported")
    ids = {t["content"]: t["id"].to_bytes(4, "little") for t in sorted(tokens, key=lambda t: -len(t["content"]))}
    return re.compile("(" + "|".join(map(re.escape, ids)) + ")") if ids else None, ids


def _encode(path: str, texts: pa.Array, added_tokens: bool) -> list[bytes]:
    """Ids of texts; with ``added_tokens``, texts are cut at the strings of the file's added tokens, which have their own ids."""
    encoder, (pattern, own) = _encoder(path), _added(path) if added_tokens else (None, {})
    if not any(pc.any(pc.match_substring(texts, token)).as_py() for token in own):
        return encoder(texts)
    cut = [pattern.split(t) for t in texts.to_pylist()]  # every second part is an added token
    ids = iter(encoder([part for parts in cut for part in parts[::2]]))
    return [b"".join(own[part] if k % 2 else next(ids) for k, part in enumerate(parts)) for parts in cut]


class ShardIndex:
    """BM25 postings of one shard, ``k1`` and ``b`` as usual. Words with an inverse document frequency of 0 or less, and
    words of a single document, rank nothing and have no postings."""

    def __init__(self, texts: list[str] | pa.Array, k1: float = 1.2, b: float = 0.75):
        split = pc.utf8_split_whitespace(strings(texts))
        numbered = split.flatten().dictionary_encode()  # words numbered as they come up
        terms, term = len(numbered.dictionary), numbered.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        words = term != pc.index(numbered.dictionary, "").as_py()  # white space at an end leaves an empty string
        term, doc = term[words], doc[words]
        entry, freq = np.unique(doc * max(1, terms) + term, return_counts=True)
        doc, term = np.divmod(entry, max(1, terms))
        length = np.bincount(doc, freq, len(texts))
        df = np.bincount(term, minlength=terms)
        idf = np.log((len(texts) - df + 0.5) / (df + 0.5))
        useful = ((df > 1) & (idf > 0))[term]
        term, doc, freq = term[useful], doc[useful], freq[useful]
        weight = idf[term] * freq * (k1 + 1) / (freq + k1 * (1 - b + b * length[doc] / max(length.mean(), 1e-9)))
        self.n = len(texts)
        self.terms_of = np.split(term, np.searchsorted(doc, np.arange(1, self.n)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))

    def ranking(self, seed: int, unused: np.ndarray) -> list[int]:
        """Unused documents that share a word with ``seed``, best first, ties in the order of the shard."""
        terms = self.terms_of[seed]
        if not len(terms):
            return []
        start, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        score[~unused] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")].tolist()


class _Packer:
    """Windows of one partition. ``rows`` are pieces (row number, start, ids, tokens of the document, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.open, self.at = window, first_sequence, [], 0

    def put(self, row: int, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while start < total:
            take = min(total - start, self.window - self.at)
            self.open.append((row, start, ids[4 * start:4 * (start + take)], total, self.sequence, self.at))
            start, self.at = start + take, self.at + take
            if self.at == self.window:
                yield from self.open
                self.open, self.at, self.sequence = [], 0, self.sequence + 1

    def close(self) -> Iterator[tuple]:
        """The incomplete window as sequences of powers of two, longest first."""
        left = [1 << k for k in range(self.at.bit_length() - 1, -1, -1) if self.at >> k & 1]
        offset = 0
        for row, start, ids, total, _, _ in self.open:
            while ids:
                take = min(len(ids) // 4, left[0] - offset)
                yield row, start, ids[:4 * take], total, self.sequence, offset
                start, ids, offset = start + take, ids[4 * take:], offset + take
                if offset == left[0]:
                    left, offset, self.sequence = left[1:], 0, self.sequence + 1


def _fill(texts: list[str] | pa.Array, ids: list[bytes], base: int, packer: _Packer) -> Iterator[tuple]:
    """Places every document of a shard."""
    index, unused = ShardIndex(texts), np.ones(len(texts), bool)
    ranked: list[int] = []
    next_seed, at = 0, 0
    for _ in range(len(texts)):
        while at < len(ranked) and not unused[ranked[at]]:
            at += 1
        if at < len(ranked):
            doc = ranked[at]
        else:
            while not unused[next_seed]:
                next_seed += 1
            doc = next_seed
        unused[doc] = False
        window = packer.sequence
        fresh = packer.at == 0 or not ranked
        yield from packer.put(base + doc, ids[doc])
        if packer.at == 0:  # the window is full: the next one takes a new seed
            ranked, at = [], 0
        elif fresh or packer.sequence != window:  # the document opened this window
            ranked, at = index.ranking(doc, unused), 0


def _shards(texts: pa.Array, shard_docs: int) -> Iterator[list[int]]:
    """How many texts each shard of a batch has, in lists of shards that are encoded together."""
    lengths = pc.binary_length(texts).to_pylist()
    together, taken, at = [], 0, 0
    while at < len(texts):
        size, chars = 0, 0
        while size < shard_docs and at + size < len(texts) and chars < SHARD_CHARS:
            chars, size = chars + lengths[at + size], size + 1
        if together and taken + chars > ENCODE_CHARS:
            yield together
            together, taken = [], 0
        together.append(size)
        taken, at = taken + chars, at + size
    if together:
        yield together


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         window: int = WINDOW, shard_docs: int = SHARD_DOCS, added_tokens: bool = False) -> DataFrame:
    """Pieces of documents laid out in sequences of ``window`` ids: the columns ``keep`` and those of ``PIECE``.

    A document's ids are those of its text and ``end_id`` (a null or empty text has that id alone). With ``added_tokens``,
    strings of the tokenizer file's added tokens become their ids, as in ``tokenizers``; else they are ordinary text. Every id is in exactly
    one piece; ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers. ``start`` counts the document's ids
    before the piece, ``offset`` the sequence's. Every sequence has ``window`` ids or a power of two, so nothing is padded.
    No shuffle: a partition of ``docs`` is packed by itself in shards, so memory is bounded by a shard, and sequence
    numbers are unique over all partitions. Repeated rows are packed each; an empty table gives an empty table.
    """
    docs = docs.select(*keep, text)
    fields = [docs.schema[name] for name in keep]
    schema = T.StructType(fields + T.StructType.fromDDL(PIECE).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window, TaskContext.get().partitionId() << 40)
        end = end_id.to_bytes(4, "little")
        held: dict[int, list] = {}  # the kept columns of rows with open pieces, by row number
        done = 0

        def rows_out(pieces: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([held[p[0]][k] for p in pieces], kinds[k]) for k in range(len(keep))]
            row, start, ids, total, sequence, offset = zip(*pieces)
            numbers = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([
                *columns, numbers(start), numbers([len(x) // 4 for x in ids]), pa.array(ids, pa.binary()), numbers(total),
                numbers(sequence), numbers(offset)], schema.fieldNames())

        for batch in batches:
            kinds, first = [batch.schema.field(k).type for k in range(len(keep))], 0
            texts = strings(batch.column(len(keep)))
            for sizes in _shards(texts, shard_docs):
                ids, at = _encode(tokenizer_path, texts.slice(first, sum(sizes)), added_tokens), 0
                for size in sizes:
                    held.update(enumerate(zip(*(c.slice(first, size).to_pylist() for c in batch.columns[:len(keep)])), done))
                    pieces = list(_fill(
                        texts.slice(first, size), [x + end for x in ids[at:at + size]], done, packer))
                    if pieces:
                        yield rows_out(pieces)
                    still = {p[0] for p in packer.open}
                    held = {k: v for k, v in held.items() if k in still}
                    done, at, first = done + size, at + size, first + size
        if packer.open:
            yield rows_out(list(packer.close()))
        _encoder(tokenizer_path).forget()  # an idle worker holds no dictionary while other steps run

    return docs.mapInArrow(run, schema)
