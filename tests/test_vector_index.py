"""The trained vector index against a scan of all rows."""

import math

import numpy as np
import pytest

from fathom.operators import vector, vector_index
from fathom.plans import catalog, tables
from fathom.plans.retrieval import _vector_index


def pairs(frame):
    return {(r.query_id, r.vec_id) for r in frame.collect()}


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_with_a_fifth_of_the_cells(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    found, true = (pairs(catalog.queries()[q](spark, folder)) for q in ("ivf_topk", "vec_dot_topk"))
    indexed, model = _vector_index(spark, folder)
    looked = vector_index.probes(tables.vector_queries(spark, folder), model, max(1, int(len(model.cells) * vector_index.SHARE))).groupBy("query_id").count()
    share = looked.agg({"count": "max"}).first()[0] / len(model.cells)
    print(sf, len(model.cells), "cells, share", share, "recall", len(found & true) / len(true))
    assert share <= 0.2 and len(found & true) >= 0.9 * len(true)
    assert indexed.select("row").distinct().count() == tables.vectors(spark, folder).count()


def test_recall_without_labels_in_many_groups(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(60, 30))
    rows = [(i, (middle[i % 60] + 0.4 * rng.normal(size=30)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    model = vector_index.fit(df)
    found = vector_index.search(vector_index.place(df, model), queries, 10, model)
    true = pairs(vector.search(df, queries, 10))
    assert len(pairs(found) & true) >= 0.9 * len(true)
    exact = {(r.query_id, r.vec_id): r.score for r in vector.search(df, queries, 3000).collect()}
    assert all(exact[r.query_id, r.vec_id] == r.score for r in found.collect())


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, []), (5, [math.nan, 0.0, 0.0]), (6, [None, 0.0, 1.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, None), (2, [1.0])], "query_id long, embedding array<double>")
    model = vector_index.fit(df.where("vec_id <> 7"))
    found = vector_index.search(vector_index.place(df, model), queries, 10, model, 1.0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == [(0, 1, 1.0), (0, 1, 1.0), (0, 2, 0.0)]
    none = vector_index.fit(df.where("false"))
    assert vector_index.search(vector_index.place(df, none), queries, 10, none).collect() == []
    again = vector_index.Model.of_frame(model.to_frame(spark))
    assert (again.cells == model.cells).all() and (again.books == model.books).all()


def test_large_cells_are_dealt_to_tiles_that_hand_on_k_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "TILE", 50)
    monkeypatch.setattr(vector_index, "BLOCK", 3)
    monkeypatch.setattr(vector_index, "AT_ONCE", 4)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=7).tolist()) for i in range(200)] + [(1000 + i, [3.0] * 7) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    model = vector_index.fit(df, 8)
    indexed = vector_index.place(df, model).cache()
    dealt = vector_index._dealt(indexed)
    assert max(parts for _, parts in dealt.values()) > 1 and max(first + parts for first, parts in dealt.values()) >= indexed.count() / 50
    queries = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    rows_of = lambda frame: {(r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect()}
    # Every cell is looked into, so what is found is what a scan finds.
    assert rows_of(vector_index.search(indexed, queries, 10, model, 1.0)) == rows_of(vector.search(df, queries, 10))
