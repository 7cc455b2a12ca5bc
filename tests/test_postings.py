"""Stored postings: the same results as a scan of all documents, from part of the blocks."""

import random

import pytest

from fathom.operators import lexical, postings
from fathom.sources import store
from fathom.sources.store import stored, written


def index(docs, block):
    lists = postings.analyzed(docs)
    stats = written(postings.corpus(lists))
    rows = written(postings.postings(lists, stats, block=block))
    return postings.Index(rows, written(postings.terms(rows)), stats)


def rows(frame):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("block,k", [(8, 10), (1, 3), (64, 400)])
def test_equals_a_scan(spark, block, k):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, "w1 w1 w1"), (903, "w1 w1 w1")]
    queries = [(1, "w0 w1 w59 w40"), (2, "w1"), (3, "nothing here"), (4, ""), (5, " ".join(words)), (6, "w58 w58 w0")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, text string")
    assert rows(postings.Search(index(d, block), lexical.query_terms(q), k, block=block).results()) == rows(lexical.top(lexical.bm25(d, q), k))


def test_reads_part_of_the_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").selectExpr("item_id AS query_id", "text")
    found = index(docs, postings.BLOCK)
    search = postings.Search(found, lexical.query_terms(queries), 10)
    assert rows(search.results()) == rows(lexical.top(lexical.bm25(docs, queries), 10))
    share = search.share_read()
    print("share of blocks read", share)
    assert share < 0.6
    assert "docs" not in search.index.postings.select("token", "block", "top").columns


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert postings.Search(index(none, 8), lexical.query_terms(q), 5).results().collect() == []


def test_a_stored_table_follows_its_source(spark, tmp_path, monkeypatch):
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/t.parquet").selectExpr("sum(id) AS s")

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert [stored(spark, str(tmp_path), "t", "sums", build).first().s for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert stored(spark, str(tmp_path), "t", "sums", build).first().s == 10 and len(made) == 2
    monkeypatch.setattr(store, "_KNOWN", {k: f"{tmp_path}/gone" for k in store._KNOWN})
    assert stored(spark, str(tmp_path), "t", "sums", build).first().s == 10 and len(made) == 3
