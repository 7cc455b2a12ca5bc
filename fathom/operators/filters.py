"""Metadata filters inside retrieval: a bitmap of ids for each key and value, and the ids that a query's filters leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a slot, a whole part of a bitmap's 32768.
SLOT = 4096


def bitmaps(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(name, value, bucket, bits): the ids that have a value in a column; values are compared in lower case.

    An id's bucket and bit are Spark's own for bitmaps. Rows without a value have no bit.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.lower(F.col(c).cast("string")).alias("value")) for c in columns))
    each = rows.select(F.col(key).cast("long").alias("id"), F.inline(pairs)).where("id is not null and value is not null")
    return each.groupBy("name", "value", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def allowed(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, bucket, bits): the ids that pass all filters of a query, a map of names to values.

    Queries without filters are not in it; filters that nothing passes leave their query without rows.
    """
    asked = queries.where("filters is not null and size(filters) > 0").select("query_id", F.size("filters").alias("count"), F.explode("filters").alias("name", "value"))
    met = asked.join(index, ["name", "value"]).groupBy("query_id", "count", "bucket").agg(F.count("*").alias("met"), F.bitmap_and_agg("bits").alias("bits"))
    return met.where((F.col("met") == F.col("count")) & (F.bitmap_count("bits") > 0)).select("query_id", "bucket", "bits")


def slot(key: Column) -> Column:
    """The number of an id's slot."""
    return F.bitmap_bucket_number(key) * (32768 // SLOT) + F.floor(F.bitmap_bit_position(key) / SLOT)


def place(key: Column) -> Column:
    """An id's bit within its slot."""
    return F.bitmap_bit_position(key) % SLOT


def cut(allow: DataFrame) -> DataFrame:
    """(query_id, slot, bits): bitmaps of ids by slot, where they have a bit."""
    each = allow.select("query_id", "bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(32768 // SLOT - 1))).alias("p"))
    bits = F.substring(F.col("bits"), F.col("p") * (SLOT // 8) + 1, F.lit(SLOT // 8))
    return each.select("query_id", (F.col("bucket") * (32768 // SLOT) + F.col("p")).alias("slot"), bits.alias("bits")).where(F.bitmap_count("bits") > 0)


def has(bits: str, position: Column) -> Column:
    """Whether a bitmap has a position's bit."""
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def passing(hits: DataFrame, queries: DataFrame, allow: DataFrame, key: str) -> DataFrame:
    """The hits (query_id, key, ...) that their query's filters allow; queries without filters keep all of theirs."""
    free = queries.where("filters is null or size(filters) = 0").select(F.col("query_id").alias("_q"))
    bound = hits.withColumn("bucket", F.bitmap_bucket_number(F.col(key))).join(allow, ["query_id", "bucket"])
    kept = bound.where(has("bits", F.bitmap_bit_position(F.col(key)))).select(hits.columns)
    return kept.unionByName(hits.join(free, hits["query_id"] == free["_q"], "left_semi"))
