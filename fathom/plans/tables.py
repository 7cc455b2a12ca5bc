"""How the driver tables stand for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.session import load

#: Extensions dealt to documents by id; the last one is unknown to the router.
EXTENSIONS = ("pdf", "doc", "docx", "ppt", "pptx", "html", "md", "txt", "mp3", "jpg", "jpeg", "png", "csv", "json", "xyz")
#: The fixed query of single-query plans.
QUERY = "from with that which aneaan"


def raw_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_key, content): documents as raw objects."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.lit("data/raw/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("raw_key"), F.col("text").alias("content"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and source."""
    return load(spark, sf_dir, "documents").select("doc_id", "text", "source")


def single_query(spark: SparkSession) -> DataFrame:
    """One query with a fixed text."""
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(QUERY).alias("text"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): the benchmark passages."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding and label."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, embedding): every vector whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
