"""Tables derived from the given ones that several queries share: indexes, written once for an application."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KNOWN: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where it is unset and all tasks run in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="fathom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, which cuts the lineage."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _state(spark: SparkSession, path: str) -> tuple:
    """Size, number of files and time of a table, by which a change is noticed."""
    files, where = _files(spark, path)
    summary = files.getContentSummary(where)
    return summary.getLength(), summary.getFileCount(), files.getFileStatus(where).getModificationTime()


def stored(spark: SparkSession, sf_dir: str, source: str, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table that build makes from a given table: written at its first use, read from then on while the source stays as it is.

    With by it is laid out in a folder for each value of that column.
    """
    key = (spark.sparkContext.applicationId, sf_dir, source, name, _state(spark, f"{sf_dir}/{source}.parquet"))
    known = _KNOWN.get(key)
    files, where = _files(spark, known) if known else (None, None)
    if not known or not files.exists(where):
        made = build()
        path = f"{shared_folder(spark)}/index-{name}-{uuid.uuid4().hex}"
        made.write.parquet(path, partitionBy=by)
        _KNOWN[key] = path
    return spark.read.parquet(_KNOWN[key])
