"""Stored postings with block maxima: an inverted index as tables, and exact BM25 top-k that reads part of its blocks.

Documents in the order of their length, then id, fall into blocks of a few. A row of the postings is a token in a block:
the documents that have it, with frequency and length, and the largest impact among them. A search joins tokens with
the maxima only, which are columns of their own, and so bounds each block's scores from above. The blocks with the
highest bounds are scored first; the k-th best score that they give is a threshold. A query's tokens of little impact,
which together stay below it, cannot lift a document to the top by themselves: candidates come from the other tokens,
in blocks that can reach the threshold, and the postings of the former are read for blocks with a candidate only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.config import RetrievalConfig
from fathom.functions.text import tokens
from fathom.operators.lexical import top
from fathom.sources.store import written

#: Documents of a block.
BLOCK = 8
#: Blocks that are scored first: for a result so many times as would hold it.
FIRST = 4
#: Scores are rounded to six places, so a bound must fall short by more than that.
ROUNDING = 2e-6


@dataclass(frozen=True)
class Index:
    """(token, block, top, docs), (token, df, top), and one row of n and avgdl."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def impact(tf: Column, dl: Column, avgdl: float, cfg: RetrievalConfig) -> Column:
    """A token's part of a score, without its weight."""
    return tf * (cfg.k1 + 1.0) / (tf + cfg.k1 * (1.0 - cfg.b + cfg.b * dl / avgdl))


def analyzed(docs: DataFrame) -> DataFrame:
    """doc_id and toks of each document."""
    return docs.select("doc_id", tokens(F.col("text")).alias("toks"))


def corpus(lists: DataFrame) -> DataFrame:
    """One row: n documents and their mean length; texts without tokens count."""
    return lists.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("toks")), F.lit(0.0)).alias("avgdl"))


def postings(lists: DataFrame, stats: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), block: int = BLOCK) -> DataFrame:
    """(token, block, top, docs) of documents given by their token lists; one shuffle of the lists, one of the postings."""
    avgdl = stats.first().avgdl or 1.0
    # Blocks are numbered within ranges of lengths, so that no task has to see all documents.
    laid = written(lists.select("doc_id", F.size("toks").alias("dl")).where("dl > 0").repartitionByRange("dl", "doc_id").withColumn("range", F.spark_partition_id()))
    number = F.floor((F.row_number().over(W.partitionBy("range").orderBy("dl", "doc_id")) - 1) / block)
    blocks = laid.select("doc_id", "dl", (F.shiftleft(F.col("range").cast("long"), 40) + number).alias("block"))
    each = lists.join(blocks, "doc_id").select("doc_id", "dl", "block", F.explode("toks").alias("token"))
    tf = each.groupBy("doc_id", "dl", "block", "token").agg(F.count("*").alias("tf"))
    return _blocks(tf, avgdl, cfg)


def _blocks(tf: DataFrame, avgdl: float, cfg: RetrievalConfig) -> DataFrame:
    weighed = tf.withColumn("impact", impact(F.col("tf"), F.col("dl"), avgdl, cfg))
    rows = weighed.groupBy("token", "block").agg(F.max("impact").alias("top"), F.collect_list(F.struct("doc_id", "tf", "dl")).alias("docs"))
    return rows.repartitionByRange("token", "block").sortWithinPartitions("token", "block")


def renamed(rows: DataFrame, names: DataFrame, stats: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Postings under other names of the tokens, given by (token, stem); what tokens of one name have is added up."""
    each = rows.join(names, "token").select(F.col("stem").alias("token"), "block", F.inline("docs"))
    return _blocks(each.groupBy("token", "block", "doc_id", "dl").agg(F.sum("tf").alias("tf")), stats.first().avgdl or 1.0, cfg)


def terms(rows: DataFrame) -> DataFrame:
    """(token, df, top) of each token of the postings."""
    return rows.groupBy("token").agg(F.sum(F.size("docs").cast("long")).alias("df"), F.max("top").alias("top"))


class Search:
    """A search of many queries, given by their terms (query_id, token); the parts are there to be looked at.

    keep drops hits (query_id, doc_id, ...) that must not be found, before any score counts.
    """

    def __init__(self, index: Index, asked: DataFrame, k: int, cfg: RetrievalConfig = RetrievalConfig(), block: int = BLOCK, keep: Callable[[DataFrame], DataFrame] = lambda hits: hits) -> None:
        stats = index.stats.first()
        self.index, self.k, self.cfg, self.avgdl, self.keep = index, k, cfg, stats.avgdl or 1.0, keep
        idf = F.log(1.0 + (F.lit(float(stats.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        #: (query_id, token, idf) of the tokens that some document has, and the most that each adds to a score.
        self.wanted = written(asked.join(index.terms, "token").select("query_id", "token", idf.alias("idf"), (idf * F.col("top")).alias("most")))
        #: (query_id, token, block, bound): every block that a query could read; the postings themselves are not read.
        self.blocks = written(index.postings.select("token", "block", "top").join(self.wanted, "token").select("query_id", "token", "block", "idf", "most", (F.col("idf") * F.col("top")).alias("bound")))
        bounds = self.blocks.groupBy("query_id", "block").agg(F.sum("bound").alias("bound"))
        best = W.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        count = FIRST * -(-k // block)
        first = bounds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= count).select("query_id", "block")
        #: The blocks that are scored first, whole.
        self.first = self.blocks.join(first, ["query_id", "block"], "left_semi")
        reached = top(self.scored(self.first), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        #: (query_id, least): the score that a result must reach; queries with fewer results have none.
        self.least = written(reached.where(F.col("n") >= k).select("query_id", (F.col("least") - ROUNDING).alias("least")))
        self._choose(bounds)

    def _choose(self, bounds: DataFrame) -> None:
        sums = F.sum("most").over(W.partitionBy("query_id").orderBy("most", "token").rowsBetween(W.unboundedPreceding, 0))
        light = self.wanted.withColumn("sum", sums).join(self.least, "query_id", "left").where("sum < least").select("query_id", "token", F.lit(True).alias("light"))
        alive = bounds.join(self.least, "query_id", "left").where("least is null or bound >= least").select("query_id", "block", "least")
        rows = written(self.blocks.join(alive, ["query_id", "block"]).join(light, ["query_id", "token"], "left"))
        #: The blocks from which candidates come.
        self.heavy = rows.where("light is null")
        rest = rows.where("light").groupBy("query_id", "block").agg(F.sum("bound").alias("rest"))
        part = self.parts(self.heavy).groupBy("query_id", "block", "doc_id").agg(F.sum("part").alias("part"), F.max("least").alias("least"))
        may = F.col("least").isNull() | (F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("least"))
        self.candidates = written(part.join(rest, ["query_id", "block"], "left").where(may).select("query_id", "block", "doc_id", "part"))
        #: The blocks of light tokens that hold a candidate.
        self.light = rows.where("light").join(self.candidates.select("query_id", "block").distinct(), ["query_id", "block"], "left_semi")

    def parts(self, chosen: DataFrame) -> DataFrame:
        """(..., doc_id, part): the documents in chosen blocks of tokens."""
        read = chosen.join(self.index.postings.select("token", "block", "docs"), ["token", "block"])
        each = read.select(*chosen.columns, F.inline("docs"))
        return self.keep(each).withColumn("part", F.col("idf") * impact(F.col("tf"), F.col("dl"), self.avgdl, self.cfg))

    def scored(self, chosen: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the documents in chosen blocks."""
        return self.parts(chosen).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))

    def results(self) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents of each query, as a scan of all would give."""
        more = self.parts(self.light).select("query_id", "block", "doc_id", "part").join(self.candidates.select("query_id", "block", "doc_id"), ["query_id", "block", "doc_id"], "left_semi")
        both = self.candidates.unionByName(more)
        return top(both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")), self.k)

    def share_read(self) -> float:
        """The share of the queries' blocks whose postings are read."""
        read = self.first.select("query_id", "token", "block").union(self.heavy.select("query_id", "token", "block")).union(self.light.select("query_id", "token", "block"))
        return read.distinct().count() / max(self.blocks.count(), 1)
