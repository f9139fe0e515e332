"""What the corpus operators share: storage in the shared folder, and texts dealt out in blocks of bounded size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertfold.session import shared_folder

# What words lie between; bytes.split() cuts at exactly these six bytes.
SPACES = r"[\x20\x09-\x0D]+"

BLOCK_BYTES, LEAST_BLOCKS = 24 << 20, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run's own below the shared folder."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps don't run it again, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def blocks_for(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks hold the texts at ``block_bytes`` each, at least ``LEAST_BLOCKS``."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(LEAST_BLOCKS, -(-total // block_bytes))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
