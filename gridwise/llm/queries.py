"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.llm import (
    alignment, bpe, decontaminate, hard_negatives, html_text, language, licenses, minhash, secret_scan, simhash, suffix_dedup,
    token_count, topk,
)
from gridwise.llm.common import read, ship


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(ship(spark), sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth, by integer inner product."""
    vectors = read(ship(spark), sf_dir, "embeddings")
    return topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur elsewhere."""
    docs = read(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.removed(docs, [
        F.col("n_bytes"), (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept"),
    ], length=400)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    found = decontaminate.contaminated(docs, items, least_words=decontaminate.SHINGLE)
    return found.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = read(ship(spark), sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, words_per_shingle=4, distance=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names or holds."""
    return licenses.recognise(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = read(ship(spark), sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    counted = token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of learning; without an id it isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from labelled documents that aren't held out."""
    docs = read(ship(spark), sf_dir, "documents")
    samples = language.learn(docs.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull()))
    found = language.identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in secret_scan.BASE],
        F.sha2(secret_scan.joined(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"),
    )


def token_digests(docs: DataFrame) -> DataFrame:
    """Encode the texts, decode the ids again, and give digests of both."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, decoded = batch.column(1), batch.column(2).to_pylist()
        flat, at = lists.flatten().to_numpy().astype("<u4"), 0
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
        ids = []
        for n in sizes:
            ids.append(hashlib.sha256(flat[at : at + n].tobytes()).hexdigest())
            at += n
        texts = [hashlib.sha256(x).hexdigest() for x in decoded]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    # Digests are taken where the ids are decoded, so that neither the bytes nor one more worker per task are needed.
    return bpe.decode(encoded, path, finish=digests, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    return token_digests(read(ship(spark), sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, by its distinct shingles of four words."""
    docs = read(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, words_per_shingle=4)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, next to its five best positives."""
    vectors = read(ship(spark), sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, label, positives=5, negatives=3, low=50, high=95, scale=256)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of every document."""
    docs = read(ship(spark), sf_dir, "documents").select("doc_id", "text")
    found = alignment.alignment(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True
    )
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text, op2_exact_top_k, op3_suffix_dedup, op4_decontaminate, op5_simhash, op6_licenses, op7_token_count,
        op8_language, op9_secrets, op10_byte_bpe, op11_minhash, op12_hard_negatives, op13_alignment,
    )
}
