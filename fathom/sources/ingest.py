"""Raw objects: listing, routing, manifests, incremental skips, sync differences and upserts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.functions.text import extension

#: Extension to parser; fixed values.
PARSERS = {
    "pdf": "pdf", "doc": "doc_docx", "docx": "doc_docx", "ppt": "ppt_pptx", "pptx": "ppt_pptx", "html": "html", "md": "md", "txt": "txt", "mp3": "mp3",
    "jpg": "png_jpeg_jpg", "jpeg": "png_jpeg_jpg", "png": "png_jpeg_jpg", "csv": "csv", "json": "json",
}
#: Extension to media type; fixed values.
MEDIA_TYPES = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "html": "text/html", "md": "text/markdown", "txt": "text/plain", "mp3": "audio/mpeg",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "csv": "text/csv", "json": "application/json",
}
UNKNOWN_TYPE = "application/octet-stream"
MANIFEST_SUFFIX = ".manifest.json"


def list_raw(spark: SparkSession, path: str, glob: str = "*", content: bool = True) -> DataFrame:
    """Objects under a path (path, modificationTime, length, content), without manifests."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    found = found.where(~F.endswith("path", F.lit(MANIFEST_SUFFIX)))
    return found if content else found.drop("content")


def _mapped(key: Column, table: dict[str, str]) -> Column:
    ext = extension(key)
    return F.coalesce(*(F.when(ext == e, F.lit(v)) for e, v in table.items()))


def route(objects: DataFrame, key: str = "raw_key") -> DataFrame:
    """Adds ext and parser; manifests are left out and unknown extensions have no parser."""
    return objects.where(~F.endswith(F.lower(key), F.lit(MANIFEST_SUFFIX))).withColumns({"ext": extension(F.col(key)), "parser": _mapped(F.col(key), PARSERS)})


def media_type(key: Column) -> Column:
    """The media type that a name suggests."""
    return F.coalesce(_mapped(key, MEDIA_TYPES), F.lit(UNKNOWN_TYPE))


def content_hash(content: Column) -> Column:
    """128 bits of the content as 32 hexadecimal digits."""
    return F.md5(content)


def blake2b(content: Column) -> Column:
    """The BLAKE2b-128 digest, for ids that other tools made."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else hashlib.blake2b(x if isinstance(x, bytes) else str(x).encode(), digest_size=16).hexdigest()), "string")(content)


def manifests(objects: DataFrame, run_id: str, key: str = "raw_key", content: str = "content") -> DataFrame:
    """One manifest for each object."""
    return objects.select(content_hash(F.col(content)).alias("file_hash"), F.col(key).alias("raw_key"), F.lit(run_id).alias("pipeline_run_id"), media_type(F.col(key)).alias("mime_type"))


def with_manifest(objects: DataFrame, known: DataFrame, key: str = "raw_key") -> DataFrame:
    """Adds document_id and mime_type from the manifests, with explicit defaults, and whether the object has an identity.

    An object without a manifest has an empty document_id and is not accepted: ids made from it would collide.
    """
    found = objects.join(known.select(key, "file_hash", "mime_type").dropDuplicates([key]), key, "left")
    identity = F.coalesce("file_hash", F.lit(""))
    return found.withColumns({"document_id": identity, "mime_type": F.coalesce("mime_type", F.lit(UNKNOWN_TYPE)), "accepted": identity != ""}).drop("file_hash")


def skip_processed(objects: DataFrame, processed: DataFrame, key: str = "file_hash", force: bool = False) -> DataFrame:
    """Objects whose hash has no chunks yet; all of them if forced."""
    return objects if force else objects.join(processed.select(key).distinct(), key, "left_anti")


def sync_difference(local: DataFrame, remote: DataFrame, key: str = "rel") -> DataFrame:
    """(rel, side): what is on one side only."""
    ours, theirs = local.select(key).distinct(), remote.select(key).distinct()
    return ours.join(theirs, key, "left_anti").withColumn("side", F.lit("local")).unionByName(theirs.join(ours, key, "left_anti").withColumn("side", F.lit("remote")))


def upsert(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_at = 1").drop("_at")


def with_errors(objects: DataFrame, parse, schema: str, content: str = "content") -> DataFrame:
    """Applies a parser hook content -> list of dicts; errors become a column and stop nothing."""

    def each(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for x in batch:
            try:
                rows.append((parse(x), None))
            except Exception as error:  # noqa: BLE001  a bad object must not stop the others
                rows.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["result", "error"])

    return objects.withColumn("_p", F.pandas_udf(each, f"result array<struct<{schema}>>, error string")(content)).select("*", "_p.result", "_p.error").drop("_p")
