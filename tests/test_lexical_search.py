"""Search of many queries in tiles: a scan's results, and rows that grow with the documents only."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import filters, lexical


def rows(frame):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


def corpus(spark, rng):
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i * 37 - 500, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(300)] + [(90000, None), (90001, ""), (90002, "w1 w1 w1"), (90003, "w1 w1 w1")]
    queries = [(1, "w0 w1 w59 w40"), (2, "w1"), (3, "nothing here"), (4, ""), (5, " ".join(words)), (6, "w58 w58 w0")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("tile,at_once,k", [(4096, 256, 10), (64, 2, 3), (8, 1, 400)])
def test_equals_a_scan(spark, monkeypatch, tile, at_once, k):
    monkeypatch.setattr(lexical, "TILE", tile)
    monkeypatch.setattr(lexical, "AT_ONCE", at_once)
    monkeypatch.setattr(lexical, "BLOCK", 2 * at_once)
    docs, queries = corpus(spark, random.Random(k))
    assert rows(lexical.search(docs, lexical.query_terms(queries), k)) == rows(lexical.top(lexical.bm25(docs, queries), k))
    none = docs.where("false")
    assert lexical.search(none, lexical.query_terms(queries), k).collect() == []


def test_filters_go_ahead_of_the_cut(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TILE", 64)
    docs, queries = corpus(spark, random.Random(3))
    tagged = docs.where("doc_id >= 0").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    asked = queries.withColumn("filters", F.when(F.col("query_id") == 1, F.create_map(F.lit("lang"), F.lit("a"))).when(F.col("query_id") == 5, F.create_map(F.lit("lang"), F.lit("zz"))))
    allow = filters.allowed(asked, filters.bitmaps(tagged, "doc_id", ["lang"]))
    got = rows(lexical.search(tagged, lexical.query_terms(asked), 7, bound=asked.where("size(filters) > 0"), allow=allow))
    scored = lexical.bm25(tagged, queries).where("query_id <> 5 and (query_id <> 1 or doc_id % 3 = 0)")
    assert got == rows(lexical.top(scored, 7)) and any(r[0] == 1 for r in got)


def test_rows_written_do_not_grow_with_the_queries(spark):
    docs, _ = corpus(spark, random.Random(5))
    count = lambda q: lexical.hits(docs, lexical.query_terms(q).select("token").distinct().select(F.col("token").alias("word"), F.monotonically_increasing_id().alias("term"))).count()
    few, many = (spark.range(n).select(F.col("id").alias("query_id"), F.lit("w0 w1 w2").alias("text")) for n in (1, 500))
    assert count(few) == count(many)


def test_what_no_filter_needs_does_not_travel(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c d"), (2, "b b d d"), (-3, "x")], "doc_id long, text string")
    found = lexical.search(docs, lexical.query_terms(spark.createDataFrame([(1, "b d"), (2, "x y")], "query_id long, text string")), 5)
    assert " AS place#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(1, 1), (1, 2), (2, -3)}
