"""Exact search in blocks, filters, stems and clusters against plain code."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import stem as st
from fathom.operators import clusters, filters, vector


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_search_in_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(vector, "BLOCK", 3)
    monkeypatch.setattr(vector, "TILE", 7)
    monkeypatch.setattr(vector, "AT_ONCE", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(60)] + [(7, [1.0] * 5)] * 20 + [(70, None), (71, []), (72, [None] * 5), (73, [0.0] * 5), (74, [1.0] * 4)]
    queries = [(i, rng.normal(size=5).round(2).tolist()) for i in range(10)] + [(20, None), (21, [0.0] * 5), (22, [2.0] * 4)]

    def score(x, q):
        dot = sum(a * b for a, b in zip(x, q))
        if metric == "dot":
            return dot
        if metric == "l2":
            return -math.dist(x, q)
        n = math.hypot(*x) * math.hypot(*q)
        return dot / n if n else None

    want = []
    for i, q in queries:
        found = [(round(score(x, q), 6), j) for j, x in rows if x and q and len(x) == len(q) and None not in x and score(x, q) is not None]
        want += [(i, j, s, r + 1) for r, (s, j) in enumerate(sorted(found, key=lambda f: (-f[0], f[1]))[:25])]
    schema = "{} long, embedding array<double>"
    got = vector.search(spark.createDataFrame(rows, schema.format("vec_id")).repartition(4), spark.createDataFrame(queries, schema.format("query_id")), 25, metric).collect()
    assert {(r.query_id, r["rank"], r.vec_id): r.score for r in got} == pytest.approx({(i, r, j): s for i, j, s, r in want}, abs=1e-6)


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_filtered_search_in_blocks(spark, monkeypatch, metric):
    for name, size in (("BLOCK", 3), ("TILE", 40), ("AT_ONCE", 2)):
        monkeypatch.setattr(vector, name, size)
    rng = np.random.default_rng(3)
    rows = [(i * 1777 - 9000, rng.normal(size=5).round(2).tolist(), i % 3) for i in range(200)] + [(7, [1.0] * 5, 1)] * 90 + [(70, None, 1), (71, [None] * 5, 1), (72, [0.0] * 5, 1), (73, [1.0] * 4, 1), (74, [2.0] * 5, None), (None, [9.0] * 5, 1)]
    queries = [(i, rng.normal(size=5).round(2).tolist(), i % 4) for i in range(9)] + [(20, None, 1), (21, [0.0] * 5, 1), (22, [2.0] * 4, 1)]
    rows_df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    asked = spark.createDataFrame([(i, q, {"label": str(g)}) for i, q, g in queries], "query_id long, embedding array<double>, filters map<string,string>")
    found = vector.search_allowed(rows_df, asked, filters.allowed(asked, filters.bitmaps(rows_df, "vec_id", ["label"])), 100, metric)
    # One id has many rows, yet no tile meets a query's whole list of them: what a pair hands on is bounded.
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()

    def score(x, q):
        dot = sum(a * b for a, b in zip(x, q))
        n = math.hypot(*x) * math.hypot(*q)
        return dot if metric == "dot" else -math.dist(x, q) if metric == "l2" else dot / n if n else None

    want = {}
    for i, q, g in queries:
        scored = [(score(x, q), j) for j, x, label in rows if j is not None and label == g and x and q and len(x) == len(q) and None not in x]
        ranked = sorted(((round(s, 6), j) for s, j in scored if s is not None), key=lambda f: (-f[0], f[1]))[:100]
        want |= {(i, r + 1, j): s for r, (s, j) in enumerate(ranked)}
    assert {(r.query_id, r["rank"], r.vec_id): r.score for r in found.collect()} == pytest.approx(want, abs=1e-6)


def test_filtered_search_places_nan_first_as_sql(spark):
    rows = spark.createDataFrame([(1, [1.0], 1), (2, [float("nan")], 1), (3, [float("inf")], 1)], "vec_id long, embedding array<double>, label int")
    asked = spark.createDataFrame([(1, [1.0], {"label": "1"})], "query_id long, embedding array<double>, filters map<string,string>")
    found = vector.search_allowed(rows, asked, filters.allowed(asked, filters.bitmaps(rows, "vec_id", ["label"])), 2)
    assert [r.vec_id for r in found.orderBy("rank").collect()] == [2, 3]


def test_filters_equal_plain_sets(spark):
    rng = random.Random(2)
    docs = [(i * 7919 - 50_000, rng.choice(["en", "DE", None]), rng.choice(["a", "b", "c"])) for i in range(400)] + [(None, "en", "a"), (0, "fr", "a"), (1, "fr", "a"), (-1, "fr", "a")]
    index = filters.bitmaps(spark.createDataFrame(docs, "doc_id long, lang string, source string"), "doc_id", ["lang", "source"])
    asked = [(1, {"lang": "en"}), (2, {"lang": "de", "source": "b"}), (3, {}), (4, None), (5, {"lang": "xx"}), (6, {"nothing": "a"}), (7, {"lang": "fr"})]
    queries = spark.createDataFrame(asked, "query_id long, filters map<string,string>")
    ids = [d[0] for d in docs if d[0] is not None]
    hits = spark.createDataFrame([(q, i, 0.5) for q, _ in asked for i in ids], "query_id long, doc_id long, score double")
    got = {(r.query_id, r.doc_id) for r in filters.passing(hits, queries, filters.allowed(queries, index), "doc_id").collect()}
    row = {d[0]: {"lang": (d[1] or "").lower(), "source": d[2]} for d in docs}
    assert got == {(q, i) for q, f in asked for i in ids if all(row[i].get(k) == v for k, v in (f or {}).items())}


def plain_stem(word):
    for rules in (st.PLURALS, st.ENDINGS):
        for suffix, instead, least in rules:
            if word.endswith(suffix) and len(word) >= len(suffix) + least:
                word = word[: len(word) - len(suffix)] + instead
                break
    return word


def test_stems(spark):
    words = ["cats", "classes", "class", "bus", "analysis", "parties", "boxes", "running", "walked", "walks", "nationalization", "relational", "hopefulness", "quickly", "die", "s", "", "is", "édités", "ing", "being", "payments", "movement", "tries", "tried", "larger", "übers"]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    got = {r.token: r.stem for r in st.stems(df).collect()}
    assert got == {w: plain_stem(w) for w in words}
    assert got["cats"] == "cat" and got["walked"] == got["walks"] == "walk" and got["class"] == "class" and got["quickly"] == "quick"
    con = duckdb.connect()
    assert all(con.execute(f"SELECT {st.stem_sql('w')} FROM (SELECT ? AS w)", [w]).fetchone()[0] == got[w] for w in words)


def test_clusters_of_candidates(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(base[:k] + ["x" + str(i)] + base[k + 1 :]) for i, k in enumerate([0, 5, 30, 59])} | {10: "other words only here", 11: None, 12: "", 13: "other words only here"}
    found = [(q, c) for q in (1, 2) for c in texts if not (q == 2 and c in (1, 2))]
    candidates = spark.createDataFrame(found, "query_id long, chunk_id long")
    docs = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    links = clusters.similar(candidates, docs)
    sets = {c: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for c, t in texts.items()}
    want = {(q, u, v) for q, u in found for p, v in found if p == q and u < v and sets[u] and 100 * len(sets[u] & sets[v]) >= 80 * len(sets[u] | sets[v])}
    assert {tuple(r) for r in links.select("query_id", "u", "v").collect()} == want and (1, 10, 13) in want
    chain = spark.createDataFrame([(1, 5, 9), (1, 9, 7), (1, 2, 3), (2, 9, 10)], "query_id long, u long, v long")
    assert {tuple(r) for r in clusters.clusters(chain).collect()} == {(1, 5, 5), (1, 7, 5), (1, 9, 5), (1, 2, 2), (1, 3, 2), (2, 9, 9), (2, 10, 9)}
    fused = spark.createDataFrame([(1, 5, 0.5), (1, 7, 0.9), (1, 8, 0.7), (1, 9, 0.4)], "query_id long, chunk_id long, final double")
    fused = fused.withColumns({c: F.col("final") for c in ("vec", "bm25", "graph", "gear")})
    best = clusters.rank_clusters(fused, clusters.clusters(chain), 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.members) for r in best] == [(7, 3), (8, 1)]


def test_passages_cut_texts_into_words_once(spark):
    from fathom.operators import fusion

    docs = spark.createDataFrame([(1, "a b c d"), (2, "x b c y"), (3, None), (4, "b")], "doc_id long, text string")
    found = fusion.containing(docs, spark.createDataFrame([(7, "b c y"), (8, "b"), (9, "b c d")], "query_id long, passage string"))
    assert "explode(array_distinct(split(text" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(7, 2), (8, 1), (8, 2), (8, 4), (9, 1)}
