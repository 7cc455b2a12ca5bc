"""Session factory and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fathom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; cluster settings win where they are given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("FATHOM_DRIVER_MEMORY", "8g"))
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory, as Spark's own reader sees it."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
