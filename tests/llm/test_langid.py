import numpy as np
import pytest

from fathom.llm import langid


def chain(emit, move):
    """Forward-backward of one text, word by word."""
    n = len(emit)
    forward, back = np.empty_like(emit), np.ones_like(emit)
    forward[0] = emit[0] / emit[0].sum()
    for t in range(1, n):
        forward[t] = (forward[t - 1] @ move) * emit[t]
        forward[t] /= forward[t].sum()
    for t in range(n - 2, -1, -1):
        back[t] = move @ (emit[t + 1] * back[t + 1])
        back[t] /= back[t].sum()
    both = forward * back
    return both / both.sum(1, keepdims=True)


def test_blocks_equal_one_pass():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 1, 31, 32, 33, 64, 65, 200, 0, 5])
    emit, move = rng.random((lengths.sum(), 4)) + 0.01, rng.random((4, 4)) + 0.01
    got, at = langid.posteriors(emit, lengths, move), 0
    for n in lengths:
        if n:
            assert np.allclose(got[at : at + n], chain(emit[at : at + n], move))
        at += n


def test_gradient_terms():
    rng = np.random.default_rng(4)
    scores, moves = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3))
    marginals, expected = langid._expectations(scores, moves)
    move = np.exp(moves)
    for s, m in zip(scores, marginals, strict=True):
        assert np.allclose(chain(np.exp(s), move), m)
    assert np.isclose(expected.sum(), 2 * 4)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy_and_inputs(spark, docs):
    out = langid.results(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    model = langid.fit(docs)
    changed = docs.selectExpr("-doc_id as doc_id", "text", "'xx' as lang", "'s' as source")
    a = {-r.doc_id: r.lang_pred for r in langid.predict(changed, model).collect()}
    assert a == {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}


def test_odd_rows_and_switched_text(spark, docs):
    model = langid.fit(docs)
    en, fr = (docs.where(f"lang = '{x}'").orderBy("doc_id").first().text.split()[:60] for x in ("en", "fr"))
    rows = [(1, None), (2, ""), (3, "123 !!! 45"), (4, " ".join(en)), (5, " ".join(fr * 3000)), (6, " ".join(en + fr)), (None, " ".join(fr))]
    odd = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "fr" and got[None][0] == "fr"
    words = next(r.words for r in langid.label_words(odd, model).collect() if r.doc_id == 6)
    assert np.mean([w.lang == ("en" if i < 60 else "fr") for i, w in enumerate(words)]) > 0.9
    assert langid.results(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.results(docs.withColumn("lang", docs.lang.substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') lang")).limit(5).collect()} == {"und"}


def plain_predict(model, text):
    """Word by word: features summed one by one, one pass of forward-backward, the mean over words with letters."""
    words = [langid.bare(w) for w in text.split()]
    if not any(words):
        return "und", 0.0
    size = len(model.labels)
    scores = [np.sum([model.weights[model.index[f]] for f in langid.features(w) if f in model.index] or [np.zeros(size)], axis=0) if w else np.zeros(size) for w in words]
    emit = np.array([np.exp(s - s.max()) + 1e-12 for s in scores])
    each = chain(emit, np.exp(model.transitions - model.transitions.max()))
    mean = np.mean([p for p, w in zip(each, words, strict=True) if w], axis=0)
    return model.labels[int(mean.argmax())], float(mean.max())


def test_predictions_equal_a_plain_version(spark, docs):
    model = langid.fit(docs)
    rows = docs.orderBy("doc_id").limit(60).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    for r in rows:
        lang, score = plain_predict(model, r.text)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-6


def test_texts_beyond_the_blocks_memory_go_word_by_word(docs, monkeypatch):
    model = langid.fit(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(20).collect()] + ["", "12 3"]
    blocks = list(langid.Tagger(model).languages(texts))
    monkeypatch.setattr(langid, "MOST_CARRIED", 0)
    for (a, x), (b, y) in zip(blocks, langid.Tagger(model).languages(texts), strict=True):
        assert a == b and abs(x - y) < 1e-6


def test_many_languages_repeated_rows_and_clashing_columns(spark):
    import random

    rng = random.Random(2)
    made = []
    for k in range(80):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
        for i in range(6):
            made.append((100 * k + i, " ".join("".join(rng.choices(letters, k=6)) for _ in range(60)), f"l{k:02}", "x", 1.5))
    rows = spark.createDataFrame(made + made[:50], "doc_id long, text string, lang string, tag string, _tag double")
    model = langid.fit(rows)
    assert len(model.labels) == 80
    out = langid.predict(rows, model)
    assert out.columns == [*rows.columns, "lang_pred", "score"] and out.where("tag = 'x' and _tag = 1.5").count() == len(made) + 50
    assert np.mean([r.lang == r.lang_pred for r in out.collect()]) > 0.8
