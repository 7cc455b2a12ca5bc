"""BM25 over documents, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.config import RetrievalConfig
from fathom.functions.text import tokens
from fathom.sources.store import written

#: Ids of a tile, a whole part of a bitmap's 32768; queries of a block; queries, and terms, that are scored at once; words that are broadcast at most.
TILE, BLOCK, AT_ONCE, MOST_WORDS = 4096, 8192, 256, 500_000


def token_lists(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, toks) of each document."""
    return docs.select(F.col(key), tokens(F.col("text")).alias("toks"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, token, tf)."""
    return token_lists(docs).select("doc_id", F.explode("toks").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n documents and their mean length in tokens."""
    return token_lists(docs).agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token): the distinct tokens of all documents."""
    return token_lists(docs).select(F.explode(F.array_distinct("toks")).alias("token")).distinct()


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token): the distinct tokens of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))


def bm25(docs: DataFrame, queries: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, doc_id, score) of every document with a query token.

    Documents give their tokens to the queries' tokens before anything is shuffled: tokens that no query names
    are dropped at the scan, and so texts never travel.
    """
    terms = query_terms(queries)
    wanted = terms.select("token").distinct()
    hits = token_lists(docs).select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("token")).join(wanted, "token", "left_semi")
    tf = hits.groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "token").crossJoin(F.broadcast(corpus_stats(docs)))  # one row
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (cfg.k1 + 1.0) / (F.col("tf") + cfg.k1 * (1.0 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")))
    scored = weighed.select("token", "doc_id", part.alias("part")).join(terms, "token")
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank; ties by key."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def hits(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of the words (word, term) in each document; term -1 stands once in every document, whatever it holds."""
    every = words.unionByName(words.sparkSession.createDataFrame([("", -1)], "word string, term long"))
    held = F.broadcast(every) if words.count() <= MOST_WORDS else every
    each = token_lists(docs).select("doc_id", F.size("toks").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "toks")).alias("word"))
    return each.join(held, "word").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def _best(k: int, avgdl: float, cfg: RetrievalConfig) -> Callable:
    def allows(asked: pd.DataFrame, places: pd.DataFrame) -> dict[int, np.ndarray]:
        """Which documents of the tile a query's filters allow; queries without filters are not in it."""
        found = {q: np.zeros(len(places), bool) for q in asked.loc[asked["bound"], "query_id"].unique()}
        for q, slot, bits in asked.loc[asked["bits"].notna(), ["query_id", "slot", "bits"]].itertuples(index=False):
            here = (places["slot"] == slot).to_numpy()
            found[q][here] |= np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[places["place"].to_numpy()[here]] == 1
        return found

    def best(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, int), "doc_id": np.zeros(0, int), "score": np.zeros(0)})]
        tf, dl = held["tf"].to_numpy(float), held["dl"].to_numpy(float)
        part = tf * (cfg.k1 + 1.0) / (tf + cfg.k1 * (1.0 - cfg.b + cfg.b * dl / avgdl))
        places = held.drop_duplicates("doc_id").sort_values("doc_id")
        ids = places["doc_id"].to_numpy()
        # In the order of terms, so that terms which are scored at once are a slice.
        order = np.argsort(held["term"].to_numpy(), kind="stable")
        terms, of = np.unique(held["term"].to_numpy()[order], return_inverse=True)
        at, part = np.searchsorted(ids, held["doc_id"].to_numpy()[order]), part[order]
        allowed, named = allows(asked, places), asked[asked["idf"].notna() & asked["term"].isin(terms)]
        queries = named["query_id"].unique()
        for low in range(0, len(queries) if len(ids) else 0, AT_ONCE):
            now = queries[low : low + AT_ONCE]
            mine = named[named["query_id"].isin(now)]
            column, asking, idf = np.searchsorted(terms, mine["term"]), pd.Index(now).get_indexer(mine["query_id"]), mine["idf"].to_numpy()
            scores = np.zeros((len(now), len(ids)))
            for first in range(0, len(terms), AT_ONCE):
                here, there = slice(*np.searchsorted(of, (first, first + AT_ONCE))), (column >= first) & (column < first + AT_ONCE)
                weights = np.zeros((len(now), AT_ONCE))
                weights[asking[there], column[there] - first] = idf[there]
                # Rows of one document and term add up.
                held_parts = np.bincount((of[here] - first) * len(ids) + at[here], part[here], AT_ONCE * len(ids)).reshape(AT_ONCE, len(ids))
                scores += weights @ held_parts
            for query, score in zip(now, scores, strict=True):
                met = np.nonzero((score > 0) & allowed[query] if query in allowed else score > 0)[0]
                found = np.round(score[met], 6)
                if len(met) > k:  # ties with the k-th stay
                    near = found >= np.partition(found, len(found) - k)[len(found) - k]
                    met, found = met[near], found[near]
                first = np.lexsort((ids[met], -found))[:k]
                out.append(pd.DataFrame({"query_id": query, "doc_id": ids[met[first]], "score": found[first]}))
        return pd.concat(out)

    return best


def search(docs: DataFrame, terms: DataFrame, k: int, cfg: RetrievalConfig = RetrievalConfig(), names: DataFrame | None = None, bound: DataFrame | None = None, allow: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents for each query's terms (query_id, token), as bm25 and top give.

    Texts are cut into words once; what stays are numbers of the words that a query names, by document. Tiles of
    documents meet blocks of queries, and each pair hands on k rows for a query, so what travels grows with the
    documents and not with the documents times the queries. names (word, token) tells which words of a text count as a
    token, else a word is its own. The queries in bound find only what allow (query_id, bucket, bits) has bits for.
    """
    wanted = written(terms.select("token").distinct().withColumn("term", F.monotonically_increasing_id()))
    words = written(names.join(F.broadcast(wanted) if wanted.count() <= MOST_WORDS else wanted, "token").select("word", "term")) if names is not None else wanted.select(F.col("token").alias("word"), "term")
    counted = written(hits(docs, words))
    n, total = counted.where("term = -1").agg(F.sum("tf"), F.sum(F.col("dl") * F.col("tf"))).first()
    n, counted = n or 0, counted.where("term >= 0")
    dfs = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = written(terms.join(wanted, "token").join(dfs, "term").select("query_id", "term", idf.alias("idf")))
    tiles, blocks = max(1, -(-n // TILE)), max(1, -(-asked.select("query_id").distinct().count() // BLOCK))
    upto = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    tile, block = F.pmod(F.col("slot"), F.lit(tiles)).alias("tile"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    slots, position = 32768 // TILE, F.bitmap_bit_position("doc_id")
    placed = counted.select("doc_id", "dl", "term", "tf", (F.bitmap_bucket_number("doc_id") * slots + F.floor(position / TILE)).alias("slot"), (position % TILE).alias("place"))
    # Where no filter needs them, slots and places stay at home.
    held = placed.select(tile, upto(blocks).alias("block"), "doc_id", "dl", "term", "tf", *(("slot", "place") if allow is not None else ()))
    own = asked.join(bound.select("query_id", F.lit(True).alias("_b")), "query_id", "left") if bound is not None else asked.withColumn("_b", F.lit(False))
    sides = own.select(upto(tiles).alias("tile"), block, "query_id", "term", "idf", F.coalesce("_b", F.lit(False)).alias("bound"), F.lit(None).cast("long").alias("slot"), F.lit(None).cast("binary").alias("bits"))
    if allow is not None:
        cut = allow.select("query_id", "bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("p")).select("query_id", (F.col("bucket") * slots + F.col("p")).alias("slot"), F.substring(F.col("bits"), F.col("p") * (TILE // 8) + 1, F.lit(TILE // 8)).alias("bits"))
        sides = sides.unionByName(cut.select(tile, block, "query_id", F.lit(None).cast("long").alias("term"), F.lit(None).cast("double").alias("idf"), F.lit(True).alias("bound"), "slot", "bits"))
    pairs = held.groupBy("tile", "block").cogroup(sides.groupBy("tile", "block"))
    return top(pairs.applyInPandas(_best(k, (total or 0) / n if total else 1.0, cfg), "query_id long, doc_id long, score double"), k)
