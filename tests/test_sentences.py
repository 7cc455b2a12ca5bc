"""Sentence boundaries with learned abbreviations, on texts whose boundaries are known."""

import random

from fathom.operators import sentences


def test_boundaries_of_a_corpus_with_abbreviations(spark):
    rng = random.Random(1)
    names, plain = ["dr", "prof", "approx", "etc"], ["tree", "house", "river", "cat", "sky", "road", "no"]
    docs, want = [], {}
    for i in range(200):
        text, ends, at = [], [], 0
        for _ in range(rng.randrange(1, 8)):
            s = [rng.choice(plain).capitalize()]
            for _ in range(rng.randrange(2, 9)):
                s += [rng.choice(names)[:5] + ".", rng.choice(["Smith", "old", "new", "small"])] if rng.random() < 0.3 else [rng.choice(plain)]
            s[-1] = s[-1].rstrip(".") + rng.choice([".", "!", "?", '."'])
            if s[-1].rstrip('.!?"') in [n[:5] for n in names]:
                s[-1] = "tree."
            text += s
            at += len(s)
            ends.append(at - 1)
        docs.append((i, " \n".join(text)))
        want[i] = ends
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, " \n "), (903, "no end")], "doc_id long, text string")
    known = sentences.abbreviations(df)
    assert {r.name for r in known.collect()} == {"dr", "prof", "etc"} | {"appro"}
    got = {r.doc_id: list(r.cuts) for r in sentences.ends(df, known).collect()}
    right = sum(len(set(got.get(i, [])) & set(e)) for i, e in want.items())
    found, true = sum(map(len, got.values())), sum(map(len, want.values()))
    print("boundary precision", right / found, "recall", right / true)
    assert right == found == true
    rows = sentences.windows(df, 2, known).orderBy("doc_id", "window").collect()
    assert {r.doc_id for r in rows} == set(want) | {903}
    for i, text in docs:
        mine = [r for r in rows if r.doc_id == i]
        assert " ".join(r.text for r in mine) == " ".join(text.split()) and sum(r.sentences for r in mine) == len(want[i])
