"""Candidates of several channels: union, min-max normalisation, weighted sum, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.config import RetrievalConfig
from fathom.functions.text import let, tokens
from fathom.sources.store import written

CHANNELS = ("vec", "bm25", "graph", "gear")


def candidates(channels: dict[str, DataFrame]) -> DataFrame:
    """(query_id, chunk_id, vec, bm25, graph, gear, gear_path): one row for each candidate of any channel.

    Channels come in long form and meet in one aggregation, which stands for a chain of full outer joins.
    """
    parts = []
    for name, rows in channels.items():
        path = F.col("path") if "path" in rows.columns else F.lit(None).cast("array<string>")
        parts.append(rows.select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.lit(name).alias("channel"), F.col("score").cast("double").alias("score"), path.alias("path")))
    every = reduce(DataFrame.unionByName, parts)
    scores = [F.max(F.when(F.col("channel") == c, F.col("score"))).alias(c) for c in CHANNELS]
    return every.groupBy("query_id", "chunk_id").agg(*scores, F.min(F.when(F.col("channel") == "gear", F.col("path"))).alias("gear_path"))


def above_thresholds(found: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """Scores below their channel's threshold count as missing; rows without any score go."""
    for name, least in (("vec", cfg.min_vec), ("bm25", cfg.min_bm25), ("graph", cfg.min_graph)):
        if least is not None:
            found = found.withColumn(name, F.when(F.col(name) >= least, F.col(name)))
    return found.where(F.coalesce(*CHANNELS).isNotNull())


def minmax(x: str, by: str = "query_id") -> Column:
    """A score between 0 and 1 within its query; missing is 0 beforehand, a constant channel is 1."""
    w = W.partitionBy(by)
    v = F.coalesce(F.col(x), F.lit(0.0))
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high - low <= 1e-12, F.lit(1.0)).otherwise((v - low) / F.when(high - low <= 1e-12, F.lit(1.0)).otherwise(high - low))


def minmax_within(rows: DataFrame, x: str, by: str, name: str) -> DataFrame:
    """Adds a score as minmax does, for groups of any size: bounds are aggregated first and then joined."""
    v = F.coalesce(F.col(x), F.lit(0.0))
    bounds = rows.groupBy(F.col(by).alias("_by")).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    wide = F.col("_high") - F.col("_low")
    scaled = F.when(wide <= 1e-12, F.lit(1.0)).otherwise((v - F.col("_low")) / F.when(wide <= 1e-12, F.lit(1.0)).otherwise(wide))
    return rows.join(bounds, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, scaled).drop("_by", "_low", "_high")


def fuse(found: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), boost: str | None = None) -> DataFrame:
    """Adds final, the weighted sum of normalised scores, over each query's whole candidate set."""
    weights = {"vec": cfg.w_vec, "bm25": cfg.w_bm25, "graph": cfg.w_graph, "gear": cfg.w_gear}
    total = sum((minmax(c) * w for c, w in weights.items()), F.lit(0.0))
    if boost:
        total = total + minmax(boost) * cfg.boost
    return found.withColumn("final", F.round(total, 6))


def order() -> list[Column]:
    """The order of fused candidates: ties go to the channel that found a chunk first, then to its best score there."""
    first = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(CHANNELS)))
    return [F.desc("final"), first, F.desc(F.coalesce(*CHANNELS)), F.col("chunk_id")]


def rank(fused: DataFrame, k: int) -> DataFrame:
    """The k best of each query."""
    w = W.partitionBy("query_id").orderBy(*order())
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rerank(ranked: DataFrame, scorer: Column | None = None) -> DataFrame:
    """Ranks anew by a hook's score; without one the order stays."""
    if scorer is None:
        return ranked
    w = W.partitionBy("query_id").orderBy(F.desc("_s"), "rank")
    return ranked.withColumn("_s", scorer).withColumn("rank", F.row_number().over(w).cast("long")).drop("_s")


def with_text(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts join last, for ranked chunks only, which cut the documents before they travel; a missing chunk keeps an empty text."""
    ranked = written(ranked)
    texts = docs.select(F.col("doc_id").alias("chunk_id"), "text", "source").join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return ranked.join(texts, "chunk_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def provenance() -> Column:
    """The raw scores and the path behind a result, as JSON."""
    return F.to_json(F.struct(*CHANNELS, "gear_path"))


def answer(ranked: DataFrame) -> DataFrame:
    """(query_id, answer): a template answer that cites each chunk with its whole text, in rank order."""
    cite = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"), F.lit(" ("), F.coalesce("source", F.lit("?")), F.lit(", p."), F.col("chunk_id").cast("string"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", cite.alias("c"))))
    return ranked.groupBy("query_id").agg(ordered.alias("o")).select("query_id", F.array_join("o.c", "\n").alias("answer"))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the documents whose text holds a passage.

    The words within a passage, its first and last left aside, are whole words of every text that holds it. The rarest
    of them leads to the candidates by an equi-join, and only these are searched. Passages of one or two words have no
    such word and are searched in all texts; they join as the few they are.
    """
    words = passages.select("query_id", "passage", F.split("passage", " ", -1).alias("w"))
    terms = words.where("size(w) > 2").select("query_id", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("word"))
    every = docs.where("text is not null").select("doc_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("word"))
    # Written, since it is read twice and texts are cut into words once.
    hits = written(every.join(terms.select("word").distinct(), "word", "left_semi"))
    rarest = terms.join(hits.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("query_id").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    candidates = hits.join(rarest, "word").select("query_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id").join(words.select("query_id", "passage"), "query_id")
    short = docs.join(words.where("size(w) <= 2"), F.contains("text", "passage"))
    return candidates.where(F.contains("text", "passage")).select("query_id", "doc_id").unionByName(short.select("query_id", "doc_id"))


def hit_at_k(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, hit): whether a true chunk is among the first k."""
    hits = ranked.where(F.col("rank") <= k).join(truth, ["query_id", "chunk_id"]).select("query_id").distinct().withColumn("h", F.lit(1))
    return truth.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("h", F.lit(0)).cast("long").alias("hit"))


def word_shingles(text: Column, n: int = 5) -> Column:
    """The distinct runs of n words of a text; a shorter text is one run, and one without words has none."""
    runs = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")))
    return let(tokens(text), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(F.array().cast("array<string>")))


def merge_near(ranked: DataFrame, percent: int = 80) -> DataFrame:
    """Adds merged_into, the best rank of a higher-ranked result of the same query that a result is a near duplicate of.

    ranked has text and at most the k results of a query, so a query's pairs are bounded by k squared.
    """
    each = ranked.withColumn("_s", word_shingles(F.col("text")))
    above = each.select(F.col("query_id").alias("_q"), F.col("rank").alias("_rank"), F.col("_s").alias("_t"))
    both = F.size(F.array_intersect("_s", "_t"))
    near = (both > 0) & (both * 100 >= (F.size("_s") + F.size("_t") - both) * percent)
    hits = each.join(above, (F.col("query_id") == F.col("_q")) & (F.col("_rank") < F.col("rank")) & near).groupBy("query_id", "rank").agg(F.min("_rank").alias("merged_into"))
    return ranked.join(hits, ["query_id", "rank"], "left")


def parse_query(queries: DataFrame) -> DataFrame:
    """(query_id, text, filters): a query in lower case with single blanks, and its key:value words as a map.

    Of a key that is given twice the last value counts.
    """
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " "), lambda w: w != "")
    is_filter = lambda w: w.rlike("^[a-z_]+:[^:]+$")
    pairs = F.transform(F.filter("w", is_filter), lambda w: F.struct(F.split(w, ":")[0].alias("key"), F.split(w, ":")[1].alias("value")))
    last = F.filter("p", lambda x, i: ~F.exists(F.slice("p", i + 2, F.size("p")), lambda y: y["key"] == x["key"]))
    each = queries.select("query_id", words.alias("w")).select("query_id", F.array_join(F.filter("w", lambda w: ~is_filter(w)), " ").alias("text"), pairs.alias("p"))
    return each.select("query_id", "text", F.map_from_entries(last).alias("filters"))
