import hashlib
import random
import re

import pytest

from fathom.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    found = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((k, m.start(), m.end()))
    return found


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_base_equals_the_plain_patterns():
    rng = random.Random(2)
    alphabet = ["1", "4", "25", "0", ".", ".", "@", "@", "a", "b.c", "-", "+", " ", "(", ")", "\n", "é", "%", "4111111111111111", "+1 (743) 555-3824", "10.0.0.1"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 30)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000 + ".", "+" * 100_000, "+1 " + "(" * 200_000, "@" * 200_000, "1 " * 100_000):
        pii.base_spans(text)


def test_added_spans(model):
    added = lambda text: [(pii.KINDS[k], text[s:e]) for k, s, e in pii.all_spans(text, model)[1]]
    assert added("call (743) 555-3824 now") == [("phone", "(743) 555-3824")]
    for text in ("on 2024-01-31 at", "digest 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "number 4785380592391138 no", "1999 2000 2001 2002", "a b c", "²³ @²"):
        assert added(text) == []


def test_best_path_equals_enumeration(model):
    """All ways to cut a group's places into spans and single steps, scored one by one."""
    for text in ("x (743) 555-3824 y", "743 555 3824", "(212) 555-0101"):
        (group,) = pii.groups(pii.candidates(text))
        places = sorted({p for s in group for p in s})

        def paths(i):
            if i == len(places) - 1:
                yield []
                return
            for rest in paths(i + 1):
                yield [(4, places[i], places[i + 1]), *rest]
            for s, e in group:
                if s == places[i]:
                    for rest in paths(places.index(e)):
                        yield from ([(y, s, e), *rest] for y in range(4))

        def score(path):
            total, before = 0.0, 4
            for y, s, e in path:
                total += model.moves[before][y] + (model.scores(pii.span_key(text, s, e))[y] if y < 4 else 0.0)
                before = y
            return total

        best = max(paths(0), key=score)
        assert sorted(model.decode(text)) == sorted(x for x in best if x[0] < 4)


def test_query_on_odd_rows(spark, model):
    texts = [None, "", "a.b@mail5.example.com, +1 (743) 555-3824, 4785380592391139, 8.196.197.208", "x", "x", "word " * 50_000 + "233.233.171.252", "999.1.1.1, call (743) 555-3824"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "x", "")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digests(docs, model).collect()}
    assert len(got) == 8
    for i, text in enumerate(texts):
        base = brute(text or "")
        assert [got[i][j + 1] for j in range(4)] == [sum(k == j for k, _, _ in base) for j in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    assert got[6].spans == "phone:16:30"
    out = {r.doc_id: r.text for r in pii.redact(spark, docs, model).collect()}
    assert out[2] == "<EMAIL>, <PHONE>, <CARD>, <IP>" and out[0] is None and out[3] == "x"
    assert pii.digests(docs.where("false"), model).count() == 0


def test_held_out_sentences(model):
    """Precision and recall of whole spans on sentences that training has not seen, and on forms that it never makes."""
    import random

    rng = random.Random(77)
    word = lambda: "".join(rng.choices(["sol", "mar", "ti", "ken", "lo", "ra", "ü"], k=rng.randint(1, 4)))
    right = found = there = 0
    for _ in range(400):
        text, gold = "", set()
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ": ", " ("])
            if rng.random() < 0.5:
                kind, entity = pii._entity(rng, word)
                gold.add((kind, len(text), len(text) + len(entity)))
            else:
                entity = pii._other(rng, word)
            text += entity + rng.choice([" ", ". ", ", ", "\n", ") "])
        base, added = pii.all_spans(text, model)
        right += len(gold & set(base + added))
        found += len(base + added)
        there += len(gold)
    print("precision", right / found, "recall", right / there)
    assert right / there > 0.93 and right / found > 0.85


def test_words_around_a_sign_of_any_length():
    long = "x" * 5000 + "@" + "y" * 5000 + ".com"
    assert (0, len(long)) in pii.candidates(long)
    assert pii.candidates("@ " * 200_000 + "a@b") == [(400_000, 400_003)]
