"""Chunk files and structural edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: All fields that any version of the chunk format has.
SCHEMA = """
chunk_id string, document_id string, chunk_type string, text string, embedding array<float>,
source struct<file_type: string, source_path: string, page_number: bigint, start_time: double, end_time: double, time: array<double>, line_range: array<bigint>, bbox: array<double>>,
graph struct<graph_node_id: string, parent_id: string, previous_id: string, next_id: string>,
metadata struct<timestamp: string, tags: array<string>, layout_tags: array<string>, entities: array<string>, used_ocr: boolean, is_multilingual: boolean, num_images: bigint, num_tables: bigint, parse_chunk_duration: bigint, parse_chunk_duration_ms: bigint, custom: map<string, string>>,
entities array<string>, triplets array<struct<subject: string, predicate: string, object: string>>
"""
LINKS = ("parent_id", "previous_id", "next_id")


def read_chunks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Chunks of any version under one schema; renamed fields fall together."""
    found = spark.read.schema(SCHEMA).option("multiLine", not lines).json(path)
    meta = F.col("metadata")
    return found.withColumns(
        {
            "entities": F.coalesce("entities", meta["entities"]),
            "start_time": F.coalesce(F.col("source.start_time"), F.get(F.col("source.time"), F.lit(0))),
            "end_time": F.coalesce(F.col("source.end_time"), F.get(F.col("source.time"), F.lit(1))),
            "parse_ms": F.coalesce(meta["parse_chunk_duration_ms"], meta["parse_chunk_duration"]),
        }
    )


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Chunks as parquet or as JSON lines."""
    writer = chunks.write.mode(mode)
    writer.parquet(path) if fmt == "parquet" else writer.json(path)


def link_pages(chunks: DataFrame) -> DataFrame:
    """Adds parent_id, previous_id and next_id; the last page has no next one."""
    w = W.partitionBy("document_id").orderBy("page_number")
    return chunks.withColumns({"parent_id": F.concat("document_id", F.lit("_page"), F.col("page_number").cast("string")), "previous_id": F.lag("chunk_id").over(w), "next_id": F.lead("chunk_id").over(w)})


def edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, relation): up to three a chunk; empty targets are left out and repeats count once."""
    each = F.array(*(F.struct(F.col(c).alias("dst"), F.lit(c).alias("relation")) for c in LINKS))
    return chunks.select(F.col("chunk_id").alias("src"), F.inline(each)).where("dst is not null and dst <> ''").distinct()


def dangling(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges to chunks that are not there."""
    return links.join(chunks.select(F.col("chunk_id").alias("dst")), "dst", "left_anti")
