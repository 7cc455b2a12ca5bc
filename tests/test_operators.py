import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathom.config import RetrievalConfig
from fathom.operators import fusion, graph, lexical, pages, serving
from fathom.sources import chunks, ingest
from fathom.streaming import streams


def test_expand_cycle_diamond_and_seeds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "zz")], "query_id long, name string")
    got = {(r.query_id, r.name): (r.hop, list(r.path)) for r in graph.expand(seeds, edges, 3).collect()}
    assert got[1, "d"] == (2, ["a", "b", "d"]) and got[1, "a"] == (2, ["a", "b", "a"]) and got[1, "e"][0] == 3
    assert got[2, "b"] == (1, ["a", "b"]) and not any(q == 3 for q, _ in got)


def test_vertices_without_chunks_and_beam(spark):
    vertices = spark.createDataFrame([("b", 1), ("c", None), ("d", 1), ("e", 2)], "name string, chunk_id long")
    reached = spark.createDataFrame([(1, "b", 1, ["a", "b"]), (1, "c", 1, ["a", "c"]), (1, "d", 2, ["a", "b", "d"]), (1, "e", 2, ["a", "c", "e"])], "query_id long, name string, hop long, path array<string>")
    found = graph.with_chunks(reached, vertices)
    assert {(r.chunk_id, r.hop) for r in graph.neighbours(found, 2).collect()} == {(1, 1), (1, 2)}
    got = {r.chunk_id: (r.score, list(r.path)) for r in graph.gear(found, 2, 20).collect()}
    assert got == {1: (0.5, ["a", "b"]), 2: (pytest.approx(0.333333), ["a", "c", "e"])}


def plain_fuse(rows, weights):
    out = []
    for c, w in weights.items():
        v = [r.get(c) or 0.0 for r in rows]
        low, high = min(v), max(v)
        out.append([w * (1.0 if high - low <= 1e-12 else (x - low) / (high - low)) for x in v])
    return [round(sum(x), 6) for x in zip(*out, strict=True)]


def test_fusion(spark):
    rows = [{"vec": 0.5, "bm25": 2.0}, {"vec": -0.3}, {"bm25": 2.0, "gear": 0.5}, {"graph": 0.5}, {"vec": 0.5, "bm25": 2.0}]
    frame = spark.createDataFrame([(1, i, r.get("vec"), r.get("bm25"), r.get("graph"), r.get("gear"), None) for i, r in enumerate(rows)], "query_id long, chunk_id long, vec double, bm25 double, graph double, gear double, gear_path array<string>")
    got = {r.chunk_id: r.final for r in fusion.fuse(frame).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(plain_fuse(rows, {"vec": 0.4, "bm25": 0.25, "graph": 0.2, "gear": 0.15}))
    one = fusion.fuse(frame.where("chunk_id = 0")).first()
    assert one.final == pytest.approx(1.0)  # every channel is constant
    ranked = [r.chunk_id for r in fusion.rank(fusion.fuse(frame), 5).orderBy("rank").collect()]
    assert ranked[:2] == [0, 4]
    assert [r.chunk_id for r in fusion.rerank(fusion.rank(fusion.fuse(frame), 5), F.col("rank")).orderBy("rank").collect()] == ranked[::-1]
    assert {r.chunk_id for r in fusion.above_thresholds(frame, RetrievalConfig(min_vec=0.2)).collect()} == {0, 2, 3, 4}


def test_candidates_keep_the_largest_score(spark):
    a = spark.createDataFrame([(1, 7, 0.5), (1, 7, 0.9)], "query_id long, chunk_id long, score double")
    b = spark.createDataFrame([(1, 8, 0.5, ["x"])], "query_id long, chunk_id long, score double, path array<string>")
    got = {r.chunk_id: r for r in fusion.candidates({"graph": a, "gear": b}).collect()}
    assert got[7].graph == 0.9 and got[7].vec is None and list(got[8].gear_path) == ["x"]


def plain_quota(times, seconds, limit):
    anchor, used, out = None, 0, []
    for t in times:
        if anchor is None or t >= anchor + timedelta(seconds=seconds):
            anchor, used = t, 0
        used += 1
        out.append((used, used <= limit))
    return out


def test_quota_batch_and_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    times = [t, t, t + timedelta(hours=23, minutes=59), t + timedelta(hours=24), t + timedelta(hours=30), t + timedelta(hours=49)]
    rows = [(u, x, 10 * u + i) for u in (1, 2) for i, x in enumerate(times)] + [(None, t, 99), (3, None, 98)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long")
    got = {r.event_id: (r.used, r.allowed) for r in serving.anchored_windows(events, 86_400, 2).collect()}
    want = {10 * u + i: x for u in (1, 2) for i, x in enumerate(plain_quota(times, 86_400, 2))}
    assert got == want
    events.write.parquet(f"{tmp_path}/events.parquet")
    stream = streams.run_once(spark, str(tmp_path), "events", lambda e: streams.quota(e, 86_400, 2), "append", close="ts")
    assert {r.event_id: (r.used, r.allowed) for r in stream.collect()} == want


def test_access(spark):
    mails = ["a@example.com", "a@EXAMPLE.com", "example.com", "", None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "i int, m string").orderBy("i")
    assert [r[0] for r in df.select(serving.domain_allowed(F.col("m"), ("example.com",))).collect()] == [True, False, False, False, False]


def test_raw_objects_and_manifests(spark, tmp_path):
    for name, body in (("a.PDF", b"one"), ("sub/b.txt", b"two"), ("a.PDF.manifest.json", b"{}"), ("noext", b"three")):
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    found = ingest.list_raw(spark, str(tmp_path / "raw")).withColumn("raw_key", F.col("path"))
    routed = {r.path.rsplit("/", 1)[1]: r.parser for r in ingest.route(found).collect()}
    assert routed == {"a.PDF": "pdf", "b.txt": "txt", "noext": None}
    made = ingest.manifests(found, "r")
    assert made.count() == 3 and ingest.skip_processed(made, made.limit(0)).count() == 3 and ingest.skip_processed(made, made).count() == 0
    assert ingest.skip_processed(made, made, force=True).count() == 3
    parsed = ingest.with_errors(found, lambda x: [{"n": 6 // (len(x) - 3)}], "n: int")
    assert {(r.error or "")[:4] for r in parsed.collect()} == {"", "Zero"}
    assert ingest.manifests(found, "r").select(ingest.blake2b(F.lit("x").cast("binary"))).first()[0] is not None


def test_chunk_versions_and_edges(spark, tmp_path):
    old = {"chunk_id": "d_1", "document_id": "d", "text": "é", "embedding": None, "source": {"start_time": 1.5}, "metadata": {"entities": ["x"], "parse_chunk_duration": 5, "custom": {}}}
    new = {"chunk_id": "d_2", "document_id": "d", "text": "t", "embedding": [0.5], "source": {"time": [2.0, 3.0]}, "metadata": {"parse_chunk_duration_ms": 7}, "entities": ["y"]}
    for i, x in enumerate((old, new)):
        (tmp_path / f"{i}.json").write_text(json.dumps(x, indent=2))
    got = {r.chunk_id: r for r in chunks.read_chunks(spark, str(tmp_path)).collect()}
    assert got["d_1"].entities == ["x"] and got["d_1"].parse_ms == 5 and got["d_1"].start_time == 1.5
    assert got["d_2"].end_time == 3.0 and got["d_2"].parse_ms == 7 and got["d_2"].entities == ["y"]
    out = str(tmp_path / "out")
    chunks.write_chunks(chunks.read_chunks(spark, str(tmp_path)).select("chunk_id", "text"), out, "json")
    assert spark.read.json(out).count() == 2
    linked = chunks.link_pages(spark.createDataFrame([("d_1", "d", 1), ("d_3", "d", 3), ("e_1", "e", 1)], "chunk_id string, document_id string, page_number long"))
    edges = {(r.src, r.dst, r.relation) for r in chunks.edges(linked).collect()}
    assert {e for e in edges if e[2] != "parent_id"} == {("d_1", "d_3", "next_id"), ("d_3", "d_1", "previous_id")}
    assert chunks.dangling(chunks.edges(linked), linked).count() == 3


def test_layout(spark):
    words = spark.createDataFrame([(1, "b", 10.04, 5.0), (1, "a", 10.0, 1.0), (1, "c", 12.0, 0.0)], "page int, text string, top double, x0 double")
    assert [r.line for r in pages.words_to_lines(words).orderBy("top").collect()] == ["a b", "c"]
    items = spark.createDataFrame([(1, "text", 5.0, 0, "t"), (1, "table", 9.0, 0, "T"), (1, "image", 5.0, 0, "i")], "page int, kind string, top double, idx int, text string")
    assert pages.merge_layout(items).first().text == "T\nt\ni"


def test_bm25_of_an_empty_corpus_and_query(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two two")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "two"), (2, "")], "query_id long, text string")
    assert [r.doc_id for r in lexical.bm25(docs, queries).collect()] == [3]
    assert lexical.bm25(docs.where("false"), queries).count() == 0


def test_json_depth_markdown_and_filters(spark):
    from fathom.operators import chunkers

    rows = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":"x"}],"d":null},"e":"{not}"}'), (2, "[1,2]"), (3, "5"), (4, None), (5, "{bad"), (6, "{}")], "id int, j string")
    assert {(r.id, r.path, r.value) for r in chunkers.json_paths(rows, "id", "j").collect()} == {(1, "a.b[0]", "1"), (1, "a.b[1].c", "x"), (1, "a.d", None), (1, "e", "{not}"), (2, "[0]", "1"), (2, "[1]", "2"), (3, "", "5")}
    assert {(r.path, r.value) for r in chunkers.json_paths(rows.where("id = 1"), "id", "j", 1).collect()} == {("a", '{"b":[1,{"c":"x"}],"d":null}'), ("e", "{not}")}
    text = "# T\npara one\nstill\n\npara two\n## S\n```py\ncode\n\nmore\n```\n```\nsecond\n```\nend"
    blocks = [(r.kind, r.text) for r in chunkers.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("block").collect()]
    assert blocks == [("heading", "# T"), ("paragraph", "para one\nstill"), ("paragraph", "para two"), ("heading", "## S"), ("code", "```py\ncode\n\nmore\n```"), ("code", "```\nsecond\n```"), ("paragraph", "end")]
    asked = fusion.parse_query(spark.createDataFrame([(1, "  Find  Lang:EN the source:src3 lang:de a:b:c x "), (2, None), (3, "")], "query_id int, text string"))
    got = {r.query_id: (r.text, r.filters) for r in asked.collect()}
    assert got[1] == ("find the a:b:c x", {"source": "src3", "lang": "de"}) and got[3] == ("", {})


def test_near_results_and_passages(spark):
    ranked = spark.createDataFrame([(1, 1, "a b c d e f g h i j"), (1, 2, "A B c d e f g h i j k"), (1, 3, "z y"), (1, 4, "z y"), (1, 5, ""), (2, 1, "z y")], "query_id int, rank int, text string")
    got = {(r.query_id, r["rank"]): r.merged_into for r in fusion.merge_near(ranked).collect()}
    assert got == {(1, 1): None, (1, 2): 1, (1, 3): None, (1, 4): 3, (1, 5): None, (2, 1): None}
    docs = spark.createDataFrame([(1, "x one two three four y"), (2, "none two threes"), (3, "one two three"), (4, None), (5, "a one")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "one two three"), (2, "one"), (3, "ne two three"), (4, "not there at all")], "query_id int, passage string")
    found = {(r.query_id, r.doc_id) for r in fusion.containing(docs, passages).collect()}
    assert found == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 5), (3, 1), (3, 2), (3, 3)}


def test_row_groups_by_size(spark):
    import random

    from fathom.operators import chunkers

    rng = random.Random(1)
    rows = [(g, i, rng.choice([0, 1, 5, 40, 300])) for g in range(3) for i in range(rng.randrange(1, 200))] + [(9, 1, None)]
    df = spark.createDataFrame(rows, "g long, i long, n long").repartition(4)
    got = {(r.g, r.i): r.chunk for r in chunkers.sized_row_groups(df, "g", "i", F.col("n"), 3, 50).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((i, n or 0) for x, i, n in rows if x == g)
        size, chunk, total = max(50, 3 * sum(n for _, n in mine) / len(mine)), 0, 0
        for i, n in mine:
            want[g, i] = chunk
            total += n
            if total >= size:
                chunk, total = chunk + 1, 0
    assert got == want
