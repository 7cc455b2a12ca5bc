"""Shared parts: tables in the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources.store import shared_folder

#: Words of the filters of may_hold.
FILTER_WORDS = 1 << 19
#: Bytes of an Arrow batch, unless one row is larger.
BATCH_BYTES = 2 << 20


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, which cuts the lineage, and the table's path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to a Python worker at once by BATCH_BYTES, unless the session has a bound of its own.

    Without it a batch is a number of rows, whatever they weigh; the setting stays for what the session runs next.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def may_be_among(rows: DataFrame, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """Adds whether a row's hash may be among the keys: a filter of FILTER_WORDS words of 64 bits, broadcast for its fixed size.

    It keeps what has no partner out of the shuffle of the join that follows; where it is full, it changes nothing.
    """
    word = lambda k: F.pmod(F.shiftright(k, 6), F.lit(FILTER_WORDS))
    bit = lambda k: F.expr(f"shiftleft(1L, cast({k} & 63 as int))")
    bits = keys.groupBy(word(key).alias("_word")).agg(F.bit_or(bit(key)).alias("_bits"))
    marked = rows.withColumn("_word", word(key)).join(F.broadcast(bits), "_word", "left")
    return marked.withColumn(mark, F.coalesce(F.col("_bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("_word", "_bits")


def may_hold(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose hash may be among the keys, see may_be_among."""
    return may_be_among(rows, keys, key, "_may").where("_may").drop("_may")


def let_go(spark: SparkSession) -> None:
    """Frees the disk of shuffles that nothing reads any more.

    Spark's cleaner learns of them only when the driver's JVM collects garbage, which may be long after.
    """
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. Paths shorten by half or better each time. Only the minimum of a
    node's neighbours is gathered, so that nodes with many neighbours need no memory; each round's edges are
    a table in the shared folder. Edges from a node to itself, nulls and repeated edges do no harm.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    now, path = written(now)
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smaller = larger.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        step = larger.join(smaller, "u").select("v", "m").union(smaller).toDF("u", "v").where("u >= v").distinct()
        after, after_path = written(step)
        sign = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        removed(spark, path)
        now, path = after, after_path
        if before == sign:
            break
        before = sign
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def least_reached(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the links."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[u], least[v])
        after = least.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        after = after[after]
        if (after == least).all():
            return least
        least = after


def tiled(members: DataFrame, of: list[str], tile: int, weight: str | None = None, heaviest: int = 0) -> DataFrame:
    """The members of lists that hold several components, in tiles; adds tile, and many and few, the numbers of tiles of a list.

    members has the columns `of`, which name a list, key and c, its component. A tile has so many members on average;
    with weight, a column of members, it does not weigh more than heaviest either. The members of a list's largest
    component lie in `many` tiles with negative numbers, the others, its strays, in `few` tiles from 0 on. Members that
    are connected by the largest component need not meet, so only pairs with a tile of strays have to be compared.
    """
    tiles_of = F.count("*") / tile if weight is None else F.greatest(F.count("*") / tile, F.sum(weight) / heaviest)
    counts = members.groupBy(*of, "c").agg(tiles_of.alias("m"))
    lists = counts.groupBy(*of).agg(F.max_by("c", F.struct("m", "c")).alias("most"), F.max("m").alias("many"), F.sum("m").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    tiles = lists.select(*of, "most", F.ceil("many").cast("int").alias("many"), F.greatest(F.ceil(F.col("m") - F.col("many") - 1e-6), F.lit(1)).cast("int").alias("few"))
    stray, place = F.col("c") != F.col("most"), F.xxhash64("key", F.lit(1))
    placed = members.join(tiles, of).withColumn("tile", F.when(stray, F.pmod(place, F.col("few"))).otherwise(F.lit(-1) - F.pmod(place, F.col("many"))).cast("int"))
    return placed.select(*members.columns, "tile", "many", "few")


def dealt(members: DataFrame, of: list[str], tile: int) -> DataFrame:
    """The tiled members, once for each pair of tiles (i, j) that has to be compared; adds tile, i and j.

    A few strays in a large list so cost as much as the list is long.
    """
    placed = tiled(members, of, tile)
    other = F.explode(F.sequence(F.when(F.col("tile") >= 0, -F.col("many")).otherwise(F.lit(0)), F.col("few") - 1))
    rows = placed.select(*members.columns, "tile", other.alias("other"))
    return rows.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other")
