"""From documents to packed training sequences.

Quality rules, near-duplicate removal, removal of repeated byte strings, packing. Each stage works on all rows that the
one before it kept; every stage but the last returns the columns of its input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertfold.llm import packing, quality, simhash, suffixes
from alertfold.llm.common import free_name, stored, table


# A passage of 51 words of the given languages has more bytes than this; most of them have fewer than 400.
REPEAT_BYTES = 272


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence rules keep."""
    verdict = free_name(docs, "quality")
    return quality.judge(docs, into=verdict).where(F.col(f"{verdict}.kept")).drop(verdict)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHashes of 5-word shingles within 18 bits propose links, a Jaccard
    similarity of the texts' 5-word shingles of 0.8 or more confirms them."""
    return simhash.keep_one_similar(docs, words=5, radius=18, share=0.8)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings of ``REPEAT_BYTES``; a character that a cut leaves incomplete goes too. ``n_chars``
    is that of the new text. A null text stays null, and a document stays even if nothing is left of it."""
    row, names = free_name(docs, "row"), docs.columns
    cut = suffixes.remove_repeats(
        docs.select(F.struct(*[c for c in names if c != "text"], F.col("text").isNull().alias(row)).alias(row), "text"),
        id_column=row, window=REPEAT_BYTES)
    whole = F.when(~F.col(f"{row}.{row}"), F.try_validate_utf8(F.col("kept")))
    text = F.when(F.col(f"{row}.{row}"), F.lit(None)).otherwise(F.coalesce(whole, _without_broken("kept")))
    out = cut.withColumn(free_name(cut, "new"), text)
    new = out.columns[-1]
    return out.select(*[
        F.col(new).alias("text") if c == "text"
        else F.char_length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"{row}.{c}").alias(c)
        for c in names])


def _without_broken(column: str):
    """The text of bytes in which incomplete characters are left out."""
    return F.replace(F.make_valid_utf8(F.col(column)), F.lit("\ufffd"), F.lit(""))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, added_tokens=True)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("bm25_packing", pack_sequences),
]
ORACLE_SQL = None  # SQL expresses none of the last three; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
