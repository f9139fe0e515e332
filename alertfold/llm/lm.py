"""Scores of whole documents by unigram counts and by a recurrent language model trained on the corpus.

Counts: every task counts the words of its training documents, a shuffle adds them up. Model: the most frequent words are
its vocabulary (a parameter), all other words are one token that is worth the word's smoothed share of what is left.
Every task trains a copy of the same initial model on all of its training documents and the copies are averaged, weighted
by tokens, in rounds of bounded groups. Scoring is one pass over all documents; the counts of words outside a head
dictionary of bounded size come from a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from alertfold.llm import gru
from alertfold.llm.common import stored

END_WORD = "\n"  # stands for the end of a text; no word holds a line break
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TOGETHER = 3_000_000  # tokens that are laid out in lanes at a time
_COUNTED = 500_000  # distinct words a task holds before it hands them on
_AVERAGED = 64  # models that one group averages


@dataclass(frozen=True)
class Settings:
    vocabulary: int = 1024
    head: int = 65536
    hidden: int = 16
    per_class: int = 32
    rate: float = 0.15
    first_squares: float = 1e-5
    seed: int = 7


def words_of(text: str | None) -> list[bytes]:
    """Words in order; only A-Z are lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


def in_training(id_column: Column) -> Column:
    """False for documents whose crc32 of the id's text leaves 1 by 5. A document without id is in training."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5, F.lit(0)) != 1


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and its count ``c``, one end per document included, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(words_of(value.as_py()))
                counts[END_WORD.encode()] += 1
                if len(counts) > _COUNTED:
                    yield out()
                    counts = Counter()
        yield out()

    return docs.select(text).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _texts(batches: Iterator[pa.RecordBatch], column: int, ids: dict[bytes, int], also=lambda words: None) -> Iterator[tuple]:
    """Rows, what ``also`` makes of their words, and their token numbers, some ``_TOGETHER`` tokens at a time."""
    rows, made, texts, size = [], [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            words = words_of(batch.column(column)[k].as_py())
            texts.append(np.fromiter(chain(map(ids.get, words, repeat(gru.OTHER)), (gru.END,)), np.int32, len(words) + 1))
            made.append(also(words))
            rows.append([c[k] for c in batch.columns[:column]])
            size += len(words) + 1
            if size >= _TOGETHER:
                yield rows, made, texts
                rows, made, texts, size = [], [], [], 0
    if texts:
        yield rows, made, texts


def train(docs: DataFrame, weights: dict[str, np.ndarray], ids: dict[bytes, int], settings: Settings,
          text: str = "text") -> dict[str, np.ndarray]:
    """The token-weighted mean of the models that the tasks train on their rows, each from ``weights``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = gru.Gru({k: v.copy() for k, v in weights.items()})
        squares = {k: np.full_like(v, settings.first_squares) for k, v in weights.items()}
        tokens = 0
        for _, _, texts in _texts(batches, 0, ids):
            model.train(texts, squares, settings.rate)
            tokens += sum(map(len, texts))
        if tokens:
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([tokens], pa.int64()),
                pa.array([gru.pack(model.w).tobytes()], pa.binary())], ["part", "tokens", "model"])

    def average(models: pa.Table) -> pa.Table:
        share = np.array(models.column("tokens").to_pylist(), np.float64)
        flat = [np.frombuffer(m.as_py(), gru.F32) for m in models.column("model")]
        mean = sum(s * f.astype(np.float64) for s, f in zip(share, flat)) / share.sum()
        return pa.table({"part": pa.array([min(models.column("part").to_pylist()) // _AVERAGED], pa.int64()),
                         "tokens": pa.array([int(share.sum())], pa.int64()),
                         "model": pa.array([mean.astype(gru.F32).tobytes()], pa.binary())})

    kind = "part long, tokens long, model binary"
    models = stored(docs.select(text).mapInArrow(run, kind), "models")
    while (found := models.count()) > 1:
        models = stored(models.groupBy(F.expr(f"part div {_AVERAGED}")).applyInArrow(average, kind), "models")
    if not found:
        return weights
    return gru.unpack(np.frombuffer(bytes(models.first()["model"]), gru.F32), weights)


def _head(counts: DataFrame, size: int) -> dict[bytes, int]:
    """The most frequent words, at most ``size``, most frequent first: all words above a count that a histogram of at
    most a thousand bins gives, so that no task and not the driver holds more."""
    bins = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("bin")).agg(
        F.min("c").alias("least"), F.count("*").alias("n")).collect()
    least, held = None, 0
    for row in sorted(bins, key=lambda r: -r["bin"]):
        held += row["n"]
        if held > size:
            break
        least = row["least"]
    if least is None:
        return {}
    rows = counts.where(F.col("c") >= least).collect()
    return {r["word"].encode(): r["c"] for r in sorted(rows, key=lambda r: (-r["c"], r["word"]))}


def score(docs: DataFrame, text: str = "text", id_column: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: its id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Tokens are the words of the whole text and one end. ``base_score`` adds log10((c + 0.5) / (N + 0.5 (V + 1))) with the
    counts over all training documents; ``score`` is the model's. A null or empty text is one end; a null id is in
    training; repeated rows get a row each; without training documents every count is 0; an empty table gives none.
    """
    docs = docs.select(F.col(id_column), in_training(F.col(id_column)).alias("training"), F.col(text).alias("text"))
    counts = stored(count_words(docs.where("training")), "word-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    head = _head(counts, settings.head)
    ends = head.pop(END_WORD.encode(), None)
    if ends is None:  # fewer training documents than the least count of the head
        ends = (counts.where(F.col("word") == END_WORD).agg(F.sum("c").alias("c")).first()["c"]) or 0
    top = list(head)[:settings.vocabulary - 2]
    ids = {w: k + 2 for k, w in enumerate(top)}
    rest_n, rest_v = n - ends - sum(head[w] for w in top), v - len(top) - (ends > 0)
    shares = np.array([ends, rest_n, *(head[w] for w in top)], np.float64) + 0.5
    start = gru.initial(np.log(shares / shares.sum()), settings.hidden, settings.per_class, settings.seed)
    weights = train(docs.where("training"), start, ids, settings)

    base_of, rest_of = np.log10(n + 0.5 * (v + 1)), np.log10(rest_n + 0.5 * (rest_v + 1))
    logs = {w: float(np.log10(c + 0.5)) for w, c in head.items()}
    field = docs.schema[id_column]
    schema = T.StructType([field, *T.StructType.fromDDL(
        "training boolean, row long, log_p double, n_tokens long, n_known long, logs double, other_logs double, "
        "n_other long, rare array<string>, times array<long>").fields])

    def counted(words: list[bytes]) -> tuple:
        known, of_all, other, of_other, rare, times = int(ends > 0), float(np.log10(ends + 0.5)), 0, 0.0, [], []
        for w, t in Counter(words).items():
            value = logs.get(w)
            if value is None:
                rare.append(w.decode())
                times.append(t)
                other += t
            else:
                known += t
                of_all += t * value
                if w not in ids:
                    other += t
                    of_other += t * value
        return len(words) + 1, known, of_all, of_other, other, rare, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = gru.Gru(weights), TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
        for rows, made, texts in _texts(batches, 2, ids, counted):
            log_p = model.score(texts) / np.log(10)
            for at in range(0, len(rows), 1024):
                to = min(at + 1024, len(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0].as_py() for r in rows[at:to]], rows[0][0].type), pa.array([r[1].as_py() for r in rows[at:to]]),
                    pa.array(range(row + at, row + to), pa.int64()), pa.array(log_p[at:to]),
                    *(pa.array(c, t) for c, t in zip(zip(*made[at:to]), kinds))], schema.fieldNames())
            row += len(rows)

    scored = stored(docs.mapInArrow(run, schema), "scored")
    rare = (scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
            .join(counts.withColumnRenamed("word", "rare"), "rare", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("rare_known"),
                                F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("rare_logs")))
    plus = lambda name: F.coalesce(name, F.lit(0))
    return scored.drop("rare", "times").join(rare, "row", "left").select(
        id_column, (~F.col("training")).alias("held_out"), "n_tokens", (F.col("n_known") + plus("rare_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + plus("rare_logs") - F.col("n_tokens") * F.lit(float(base_of))).alias("base_score"),
        (F.col("log_p") + F.col("other_logs") + plus("rare_logs") - F.col("n_other") * F.lit(float(rest_of))).alias("score"))
