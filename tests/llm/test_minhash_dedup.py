import random

from fathom.llm import minhash_dedup as md
from tests.llm.test_common import plain


def plain_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = [(r[0], plain_set(r[1])) for r in rows]
    edges = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                edges.append((a, b))
    reach = plain(edges)
    return sorted(((a, len(x), reach.get(a, a), True if a is None else reach.get(a, a) == a) for a, x in sets), key=str)


def words(rng, n):
    return [rng.choice(["the", "er", "on", "an", "re"]) + str(rng.randrange(400)) for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = "x" + str(rng.randrange(10**6))
    return out


def test_equals_brute_force_on_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(md, "SHORT", 12)  # so that long lists occur
    monkeypatch.setattr(md, "TILE", 16)
    rows, passage = [], words(rng, 60)
    big, small = words(rng, 400), words(rng, 40)
    for i in range(70):
        rows.append(" ".join(edited(rng, big, rng.randrange(14))))
    for i in range(40):
        rows.append(" ".join(edited(rng, small, rng.randrange(3))))
    for i in range(40):
        rows.append(" ".join(passage + words(rng, rng.choice([3, 10, 40]))))
    for i in range(60):
        base = words(rng, rng.choice([6, 30, 90, 150, 600]))
        rows += [" ".join(base), " ".join(edited(rng, base, rng.randrange(4)))]
    rows += [None, "", " \t\n", "one", "ONE", "a b c d", "a b c d e", "A B C D\x0bE", "one\xa0two", "É e", "é e"]
    table = [(i, t, "clash") for i, t in enumerate(rows)] + [(3, rows[3], "again"), (None, rows[4], ""), (None, None, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string, key string")
    got = sorted(map(tuple, md.dedup(docs).collect()), key=str)
    assert got == brute(table)
    assert md.dedup(docs.where("false")).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, md.dedup(docs).collect()), key=str) == brute(rows)


def test_long_texts_in_tiles_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(md, "SHORT", 4)
    monkeypatch.setattr(md, "TILE_HASHES", 60_000)
    rng = random.Random(16)
    base = words(rng, 30_000)
    rows = [(i, " ".join(edited(rng, base, 40 * i))) for i in range(14)] + [(20, " ".join(words(rng, 20_000))), (21, " ".join(base)), (None, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, md.dedup(docs).collect()), key=str) == brute(rows)


def test_near_copies_are_compared_with_one_of_them(spark, monkeypatch):
    monkeypatch.setattr(md, "SHORT", 8)
    monkeypatch.setattr(md, "TILE", 16)
    groups = []
    keep = md.tile_pairs

    def counted(tiles):
        out = keep(tiles)
        groups.extend(r["count"] for r in out.groupBy("value").count().collect())
        return out

    monkeypatch.setattr(md, "tile_pairs", counted)
    rng = random.Random(17)
    base = words(rng, 300)
    # Some edits apart from all others, and copies of a copy, which only others than the hub are similar to.
    far = edited(rng, base, 12)
    rows = [(i, " ".join(edited(rng, base, rng.randrange(3)))) for i in range(400)] + [(900 + i, " ".join(edited(rng, far, rng.randrange(14)))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sorted(map(tuple, md.dedup(docs).collect()), key=str) == brute(rows)
    # All pairs of 26 tiles would be 351 for each long value.
    assert max(groups, default=0) <= 60
