"""Vector search: exact scans of a query set against all rows, and pooling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.filters import cut, place, slot
from fathom.operators.lexical import top


#: Queries of a block and rows of a tile on average, each block meets each tile once; and queries that are scored at once.
BLOCK, TILE, AT_ONCE = 8192, 8192, 256
SCORES = {"dot": lambda x, q: x @ q.T, "cosine": lambda x, q: _ratio(x @ q.T, np.outer(_norms(x), _norms(q))), "l2": lambda x, q: -np.sqrt(np.stack([((x - y) ** 2).sum(1) for y in q], 1))}


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(a.shape, np.nan), where=b != 0)


def _best(k: int, metric: str):
    def best(pair: pd.DataFrame) -> pd.DataFrame:
        asked, held = pair[pair["is_query"]], pair[~pair["is_query"]]
        out = []
        if len(asked) and len(held):
            q, x = (np.stack(part["embedding"].to_numpy()).astype(float) for part in (asked, held))
            ids, asking = held["id"].to_numpy(), asked["id"].to_numpy()
            for low in range(0, len(q), AT_ONCE):
                scores = np.round(SCORES[metric](x, q[low : low + AT_ONCE]), 6)
                for query_id, score in zip(asking[low : low + AT_ONCE], scores.T, strict=True):
                    known = np.nonzero(~np.isnan(score))[0]
                    first = known[np.lexsort((ids[known], -score[known]))[:k]]
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[first], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return best


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))


def search(rows: DataFrame, queries: DataFrame, k: int, metric: str = "dot") -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of all rows for each query; distances are negated.

    Blocks of queries meet tiles of rows, and a pair of them hands on the k best rows of each query only. Vectors of
    another length than a query's, with null components or null are not found. Ids are whole numbers.
    """
    x, q = _usable(rows.select("vec_id", "embedding")), _usable(queries.select("query_id", "embedding"))
    tiles, blocks = (max(1, -(-df.count() // size)) for df, size in ((x, TILE), (q, BLOCK)))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    # Rows of one id, of which there may be many, go to different tiles.
    held = x.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(tiles)).alias("tile"), F.explode(upto(blocks)).alias("block"), F.lit(False).alias("is_query"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = q.select(F.explode(upto(tiles)).alias("tile"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.lit(True).alias("is_query"), F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    pairs = held.unionByName(asked).withColumn("dim", F.size("embedding"))
    found = pairs.groupBy("tile", "block", "dim").applyInPandas(_best(k, metric), "query_id long, vec_id long, score double")
    return top(found, k, "vec_id")


def _first(scores: np.ndarray, known: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of the k best known scores of each query; ties by id, and NaN is above all numbers as in Spark's order."""
    key = np.where(known, np.where(np.isnan(scores), np.inf, scores), -np.inf)
    if len(ids) > k:  # ties with the k-th stay
        known = known & (key >= np.partition(key, len(ids) - k, axis=1)[:, len(ids) - k, None])
    of, row = np.nonzero(known)
    order = np.lexsort((ids[row], -key[of, row], ~np.isnan(scores[of, row]), of))
    of, row = of[order], row[order]
    best = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[best], row[best]


def _best_allowed(k: int, metric: str):
    def best(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        # Queries whose filters leave the same rows are scored together, and against these rows only.
        for (number, bits), mine in asked.assign(bits=asked["bits"].map(bytes)).groupby(["slot", "bits"], sort=False):
            here = held[(held["slot"] == number).to_numpy()]
            here = here[np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[here["place"].to_numpy()] == 1]
            if not len(here):
                continue
            x, ids, asking = np.stack(here["embedding"].to_numpy()).astype(float), here["id"].to_numpy(), mine["query_id"].to_numpy()
            for low in range(0, len(mine), AT_ONCE):
                q = np.stack(mine["q"].to_numpy()[low : low + AT_ONCE]).astype(float)
                known = np.outer(_norms(q), _norms(x)) != 0 if metric == "cosine" else np.ones((len(q), len(x)), bool)
                scores = np.round(SCORES[metric](x, q).T, 6)
                of, row = _first(scores, known, ids, k)
                out.append((asking[low : low + AT_ONCE][of], ids[row], scores[of, row]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return best


def search_allowed(rows: DataFrame, queries: DataFrame, allow: DataFrame, k: int, metric: str = "dot") -> DataFrame:
    """As search, among the rows that a query's filters allow: filters.allowed goes ahead of all products.

    Tiles of rows meet blocks of queries by the slot of their ids, so a query takes up only the slots in which it may
    find something, and a tile hands on k rows for a query. Slots with many rows of one id are dealt to several tiles.
    """
    x, q = _usable(rows.select("vec_id", "embedding").where("vec_id is not null")), _usable(queries.select("query_id", "embedding"))
    tiles, blocks = (max(1, -(-df.count() // size)) for df, size in ((x, TILE), (q, BLOCK)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    tile, block = F.pmod("slot", F.lit(tiles)).alias("tile"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    placed = x.select(slot(F.col("vec_id")).alias("slot"), place(F.col("vec_id")).alias("place"), F.col("vec_id").cast("long").alias("id"), "embedding").select("*", tile)
    parts = placed.groupBy("tile").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    held = placed.join(parts, "tile").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "parts")).select("tile", "part", upto(F.lit(blocks)).alias("block"), F.size("embedding").alias("dim"), "slot", "place", "id", "embedding")
    asked = q.join(cut(allow), "query_id").select(tile, block, F.size("embedding").alias("dim"), "slot", F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q"), "bits").join(parts, "tile").withColumn("part", upto(F.col("parts")))
    keys = ("tile", "part", "block", "dim")
    found = held.groupBy(*keys).cogroup(asked.drop("parts").groupBy(*keys)).applyInPandas(_best_allowed(k, metric), "query_id long, vec_id long, score double")
    # NaN comes back from pandas as null.
    return top(found.withColumn("score", F.coalesce("score", F.lit(float("nan")))), k, "vec_id")


def mean_pool(rows: DataFrame, by: str) -> DataFrame:
    """(by, dim, mean): the mean of each dimension."""
    each = rows.select(by, F.posexplode("embedding").alias("dim", "x"))
    return each.groupBy(by, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
