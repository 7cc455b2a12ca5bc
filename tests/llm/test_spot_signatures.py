"""SpotSigs against plain sets and all pairs."""

import hashlib
import random
import re

import pytest

from fathom.llm import common
from fathom.llm import spot_signatures as c

SCHEMA = "doc_id long, text string, name string, id string, c int"


def plain_signatures(text):
    words = [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in c.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in c.COMMON][: c.CHAIN]
            if len(chain) == c.CHAIN:
                out.add((w, *chain))
    return out or ({tuple(words)} if words else set())


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_components(rows):
    sets = [plain_signatures(t) for _, t in rows]
    root = list(range(len(rows)))
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 80 * len(a | b)]
    for i, j in linked:
        x, y = root[i], root[j]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None) if rows[i][0] is not None else None for i in range(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(3)


def check(spark, rows):
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in c.digests(frame(spark, rows)).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        row = got[i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        a, b = plain_signatures(t), plain_signatures(edited)
        assert row.n_signatures == len(a)
        assert row.near_edited == pytest.approx(like(a, b)) and row.near_next == pytest.approx(like(a, plain_signatures(after)))
        assert (row.fingerprint == row.edited_fingerprint) == (a == b)
    by = {}
    for r in got.values():
        by.setdefault(r.doc_id, set()).add(r.component_id)
    want = {}
    for (i, _), x in zip(order, plain_components(order)):
        want.setdefault(i, set()).add(x)
    assert by == want
    return got


def prose(rng, n, vocabulary=300):
    return " ".join(rng.choice(c.COMMON) if rng.random() < 0.4 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edit(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_signatures_equal_plain_ones(spark):
    rng = random.Random(1)
    texts = [None, "", "...", "the", "the of", "the cat", "the cat sat", "cat sat the", "the the of cat a sat the mat", "Der HUND läuft, 7 mal!", "x\n\tthe\ny z", *(prose(rng, n) for n in (3, 9, 40, 2000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", c.signatures(c.F.col("text")).alias("s")).collect()
    for r in rows:
        assert r.s == sorted(set(r.s)) and len(r.s) == len(plain_signatures(r.text)), r.text


def test_digests_of_edits_copies_and_edge_cases(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    texts += [edit(rng, t, 0.02) for t in texts[:20]] + texts[5:12]
    rows = list(enumerate(texts)) + [(200, None), (201, ""), (202, "one"), (203, "one"), (204, "😀é the big 漢字 tree"), (-5, texts[0])]
    check(spark, rows)


def test_null_and_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30)) for i in range(6)]
    got = c.digests(frame(spark, [*rows, rows[2], rows[2], (None, rows[1][1])])).collect()
    assert len(got) == 9 and len({r for r in got if r.doc_id == 2}) == 1
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    check(spark, [*rows, (None, rows[1][1])])


def test_empty_table_and_single_document(spark):
    assert c.digests(frame(spark, [])).collect() == []
    (row,) = c.digests(frame(spark, [(7, "the cat sat on the mat near the old tree")])).collect()
    assert row.near_next == 1.0 and row.component_id == 7 and row.kept
    assert c.dedup(frame(spark, [])).collect() == []


def test_long_lists_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(c, "SHORT", 4)
    monkeypatch.setattr(c, "TILE", 5)
    rng = random.Random(4)
    base, other = prose(rng, 400), prose(rng, 400)
    texts = [edit(rng, base, rng.choice([0.01, 0.05, 0.1])) for _ in range(60)] + [edit(rng, other, 0.05) for _ in range(12)] + [base + " " + prose(rng, 90) for _ in range(6)]
    check(spark, list(enumerate(texts)))


def test_strays_are_compared_with_all_and_each_other(spark):
    rows = [("l", k, 0) for k in range(40)] + [("l", 100 + k, 100 + k // 2) for k in range(9)] + [("one", 1, 0), ("one", 2, 0)]
    groups = common.dealt(spark.createDataFrame(rows, "list string, key long, c long"), ["list"], 4).collect()
    met = {}
    for g in groups:
        met.setdefault((g.list, g.i, g.j), []).append(g)
    pairs = [tuple(sorted((a.key, b.key))) for (_, i, j), m in met.items() for a in m for b in m if a.key < b.key and (i == j or a.tile != b.tile)]
    apart = [p for p in pairs if dict((k, x) for _, k, x in rows[:49])[p[0]] != dict((k, x) for _, k, x in rows[:49])[p[1]]]
    assert len(apart) == len(set(apart)) == 40 * 9 + 9 * 8 // 2 - 4
    assert all(p[1] >= 100 for p in pairs) and all(g.list == "l" for g in groups)
