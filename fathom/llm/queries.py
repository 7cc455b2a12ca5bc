"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathom.llm import bpe, centroids, embed_dedup, langid, license_scan, line_dedup, media, minhash_dedup, packing, pii, secret_scan, spot_signatures, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links all vectors of a label with a cosine of 0.93 or more."""
    return embed_dedup.dedup(_table(spark, sf_dir, "embeddings"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps one of each group of similar lines over all documents."""
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds secrets in every document through the trigram index."""
    return secret_scan.digests(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of the permitted lengths."""
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds personal data in every document."""
    return pii.digests(_table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every document with a field trained on those that are not held out."""
    return langid.results(_table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document as a progressive JPEG file, reads it back and decodes its tensor."""
    return media.digests(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names the licence families in every document."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links documents by the similarity of their shingle sets."""
    return minhash_dedup.dedup(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the public byte-level vocabulary."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes all vectors by parts, with codebooks trained on all of them."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters all vectors around centroids."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every document, its edited text, and compares them and the next document."""
    return spot_signatures.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {"op1_embeddings": op1_embeddings, "op2_lines": op2_lines, "op3_secrets": op3_secrets, "op4_packing": op4_packing, "op5_pii": op5_pii, "op6_langid": op6_langid, "op7_media": op7_media, "op8_licenses": op8_licenses, "op9_minhash": op9_minhash, "op10_bpe": op10_bpe, "op11_codes": op11_codes, "op12_centroids": op12_centroids, "op13_spotsigs": op13_spotsigs}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_embeddings": embed_dedup.oracle(), "op3_secrets": secret_scan.oracle(), "op11_codes": vector_codes.oracle(), "op12_centroids": centroids.oracle()}
