import random

import corpus_pipeline
from fathom.llm import langid, pii
from tests.llm import test_line_dedup, test_minhash_dedup, test_packing


def test_run_equals_plain_versions_stage_by_stage(spark, tmp_path):
    rng = random.Random(12)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in table.collect()]
    copies = [(5000 + i, test_minhash_dedup.edited(rng, r[1].split(" "), 1), *r[2:]) for i, r in enumerate(rows[:20])]
    rows += [(i, " ".join(t), *r) for i, t, *r in copies]
    rows += [(9000, None, None, "s", None), (9001, "", "en", "s", 0), (9002, "12 34 !!", "en", "s", 8), (9003, rows[0][1] + "\ncall (743) 555-3824 or a.b@c.org", None, "s", 1)]
    spark.createDataFrame(rows, table.schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    step = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    tagger = langid.Tagger(langid.fit(docs))
    want = {r[0] for r, (lang, score) in zip(rows, tagger.languages([r[1] or "" for r in rows]), strict=True) if lang != "und" and score >= 0.3}
    got = step.collect()
    assert step.columns == columns and {r.doc_id for r in got} == want and {9000, 9001, 9002}.isdisjoint(want) and 9003 in want
    assert all(r.lang for r in got)

    step2 = corpus_pipeline.dedup_lines(spark, step, str(tmp_path))
    texts = {r.doc_id: r.text for r in step2.collect()}
    plain = test_line_dedup.brute([(r.doc_id, r.text) for r in got])
    assert set(texts) == set(plain) and sum(texts[d] != plain[d] for d in plain) <= 0.02 * len(plain)
    assert step2.columns == columns and all(r.n_chars == len(r.text) for r in step2.collect())

    step3 = corpus_pipeline.near_duplicates(spark, step2, str(tmp_path))
    kept = {d for d, _, _, k in test_minhash_dedup.brute(sorted(texts.items()), 80) if k}
    assert {r.doc_id for r in step3.collect()} == kept and step3.columns == columns

    step4 = corpus_pipeline.redact_pii(spark, step3, str(tmp_path))
    model = pii.train()
    redacted = {r.doc_id: r.text for r in step4.collect()}
    assert redacted == {d: pii.redacted(texts[d], model) for d in kept} and step4.columns == columns

    out = corpus_pipeline.pack(spark, step4, str(tmp_path)).collect()
    words = {d: 0 for d in kept}
    for r in out:
        words[r.doc_id] += r.n_tokens
    assert words == {d: len(t.split()) for d, t in redacted.items()}
    pieces = sorted(((-r.n_tokens, r.doc_id, r.start, r.bin, r.capacity) for r in out if r.bin is not None and r.shard == 0))
    from fathom.llm import packing

    bins, capacities = test_packing.brute([-p[0] for p in pieces], packing.LENGTHS, packing.SEQUENCE_COST)
    assert [p[3] for p in pieces] == bins and [p[4] for p in pieces] == [capacities[k] for k in bins]

    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, ran.collect()), key=str) == sorted(map(tuple, out), key=str)


def test_empty_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_repeated_rows(spark, tmp_path):
    extra = ["_tag", "tag", "score", "own_score", "lang_pred", "_gone", "_d", "row", "key", "rep"]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = table.select("*", *(table.doc_id.cast("string").alias(c) for c in extra))
    wide = wide.union(wide.where("doc_id < 20"))
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == wide.columns, name
        assert docs.where(" or ".join(f"{c} <> cast(doc_id as string)" for c in extra)).count() == 0, name
    assert docs.where("doc_id < 20").groupBy("doc_id").count().where("count <> 2").count() == 0
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() >= docs.count()


def test_without_languages_only_texts_without_letters_go(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 34", None, "s", 5), (3, None, None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()] == [1]
