"""Near-duplicate candidates merged before ranking: a prefix-filtered set-similarity join, then components per query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.operators.fusion import order, word_shingles
from fathom.sources.store import written

#: Least similarity of near duplicates, in hundredths.
PERCENT = 80


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(chunk_id, s): the hashed shingles of each text that has words."""
    hashed = F.transform(word_shingles(F.col("text")), lambda x: F.xxhash64(x))
    return docs.select("chunk_id", F.array_distinct(hashed).alias("s")).where("size(s) > 0")


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(chunk_id, n, sig, left): the rarest members of each set, as many as a similar set must share one of.

    left counts the members from there on, in the order of rarity.
    """
    each = sets.select("chunk_id", F.size("s").alias("n"), F.explode("s").alias("sig"))
    known = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    ordered = known.groupBy("chunk_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("o"))
    take = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    return ordered.select("chunk_id", "n", F.posexplode(F.slice("o", F.lit(1), take)).alias("at", "c")).select("chunk_id", "n", "c.sig", (F.col("n") - F.col("at")).alias("left"))


def _enough(both: Column, n: Column, m: Column, percent: int) -> Column:
    return both * (100 + percent) >= (n + m) * percent


def similar(found: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(query_id, u, v): pairs of a query's candidates whose shingle sets are similar, u < v.

    Candidates meet in the lists of one query only, which its channels bound, so a hot text makes no long list.
    """
    wanted = found.select("chunk_id").distinct()
    sets = written(shingle_sets(docs.join(wanted, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])))
    listed = written(found.select("query_id", "chunk_id").distinct().join(prefixes(sets, percent), "chunk_id"))
    a, b = (listed.select("query_id", "sig", *(F.col(c).alias(f"{c}_{x}") for c in ("chunk_id", "n", "left"))) for x in "uv")
    n, m = F.col("n_u"), F.col("n_v")
    # Where two sets first meet in the order of rarity, what is left of each bounds what they have in common.
    may = (n * 100 >= m * percent) & (m * 100 >= n * percent) & _enough(F.least("left_u", "left_v"), n, m, percent)
    pairs = written(a.join(b, ["query_id", "sig"]).where((F.col("chunk_id_u") < F.col("chunk_id_v")) & may).select("query_id", F.col("chunk_id_u").alias("u"), F.col("chunk_id_v").alias("v")).distinct())
    tested = pairs.select("u", "v").distinct()
    for x in "uv":
        tested = tested.join(sets.select(F.col("chunk_id").alias(x), F.col("s").alias(f"s_{x}")), x)
    close = tested.where(_enough(F.size(F.array_intersect("s_u", "s_v")), F.size("s_u"), F.size("s_v"), percent)).select("u", "v")
    return pairs.join(close, ["u", "v"]).select("query_id", "u", "v")


def _joined(links: pd.DataFrame) -> pd.DataFrame:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for u, v in zip(links["u"], links["v"], strict=True):
        a, b = sorted((find(u), find(v)))
        root[b] = a
    nodes = sorted(root)
    return pd.DataFrame({"query_id": links["query_id"].iloc[0], "chunk_id": nodes, "cluster": [find(x) for x in nodes]})


def clusters(links: DataFrame) -> DataFrame:
    """(query_id, chunk_id, cluster): the least chunk that each linked candidate of a query reaches.

    One query's links are a group; its candidates, a few for each channel, bound them.
    """
    return links.groupBy("query_id").applyInPandas(_joined, "query_id long, chunk_id long, cluster long")


def rank_clusters(fused: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """The k best clusters of each query, each as its best candidate, with members, the number of its candidates."""
    every = fused.join(of, ["query_id", "chunk_id"], "left").withColumn("cluster", F.coalesce("cluster", "chunk_id"))
    placed = every.withColumn("_place", F.row_number().over(W.partitionBy("query_id").orderBy(*order())))
    cluster = W.partitionBy("query_id", "cluster")
    best = placed.withColumn("members", F.count("*").over(cluster)).withColumn("_best", F.min("_place").over(cluster)).where(F.col("_place") == F.col("_best"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_place")).cast("long")).where(F.col("rank") <= k).drop("_place", "_best")
