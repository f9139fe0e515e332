"""The corpus operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertfold.llm import (
    bpe, laesa, licenses, lm, multi_index, packing, quality, simhash, substrings, suffixes, url_filter, vantage, warc)
from alertfold.llm.common import new_folder, stored, table


def op1_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("license.ids").cast("long").alias("n_sentences"), F.array_join("license.ids", "|").alias("sentence_ids"),
        F.array_join("license.licenses", "|").alias("licenses"), F.col("license.unmatched").alias("n_unmatched"))


def op2_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, added_tokens=True)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(table(spark, sf_dir, "pages"), new_folder(spark, "warc"), min_bytes=0, roll_bytes=8 << 20)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_cover_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")


def op6_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_deep_shallow_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), window=400)
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select("doc_id", "quality.*")


def op10_gated_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_url_ngram_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.*")


def op12_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = laesa.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    coded = stored(coded.select("vec_id", "label", "coded.*"), "codes")
    # Sums are formed before rows meet them: a label that many rows have is one row of the small side.
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.sha2(F.lit(laesa.flat_text(books)).cast("binary"), 256).alias("codebooks_sha256"))


def op13_vantage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = vantage.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, seed=2)
    found = stored(found.select("vec_id", "clustered.*"), "clusters")
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # at most one row per centroid
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    if not len(centroids):
        return found.select("vec_id", "cluster", "distance", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    return found.select(
        "vec_id", "cluster", "distance", of([F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        of([F.lit(vantage.fingerprint(c)) for c in centroids]).alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_license_sentences, op2_bm25_packing, op3_warc_archive, op4_segment_tree_bpe, op5_cover_substrings,
    op6_inverted_multi_index, op7_simhash_tiles, op8_deep_shallow_suffixes, op9_quality_divergence, op10_gated_language_model, op11_url_ngram_filter, op12_laesa_codes, op13_vantage_clusters)}
ORACLES: dict[str, str] = {
    "op1_license_sentences": licenses.oracle("documents"), "op11_url_ngram_filter": url_filter.oracle("pages"),
    "op12_laesa_codes": laesa.oracle("embeddings"), "op13_vantage_clusters": vantage.oracle("embeddings", k=40, rounds=5)}
