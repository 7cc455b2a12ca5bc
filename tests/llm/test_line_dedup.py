import random

from pyspark.sql import functions as F

from fathom.llm import line_dedup as ld
from tests.llm.test_common import plain


def plain_set(norm):
    return {norm[i : i + 10] for i in range(max(1, len(norm) - 9))}


def brute(docs):
    """Texts with all but the first line of each component of similar lines removed."""
    lines = [(d, p, x.strip(" \t\x0b\f\r").lower()) for d, t in sorted(docs) for p, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    norms = sorted({x[2] for x in lines})
    sets = [plain_set(x) for x in norms]
    edges = [(i, j) for i in range(len(norms)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    reach = plain(edges)
    number, seen, gone = {x: i for i, x in enumerate(norms)}, set(), set()
    for d, p, x in lines:
        c = reach.get(number[x], number[x])
        if c in seen:
            gone.add((d, p))
        seen.add(c)
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in docs}


def near(rng, line, edits):
    words = line.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "w" + str(rng.randrange(10**5))
    return " ".join(words)


def test_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["the", "er", "on", "an", "re", "é"], k=rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.choice([3, 20, 60]))) for _ in range(30)]
    docs = []
    for i in range(90):
        docs.append((i, "\n".join(near(rng, rng.choice(base), rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(0, 6)))))
    docs += [(90, None), (91, ""), (92, "\n\n"), (93, " As. \nas.\n\nAS."), (94, "q" * 30_000 + "\n" + "q" * 30_000 + "x"), (95, "https://a.example/one\nhttps://a.example/two"), (96, base[1])]
    table = [(d, t, "clash") for d, t in docs] + [(96, base[1], "again")]
    frame = spark.createDataFrame(table, "doc_id long, text string, pos string")
    out = ld.dedup(frame)
    assert out.columns == frame.columns
    want, rows = brute(docs), out.collect()
    assert len(rows) == len(table)
    wrong = [r.doc_id for r in rows if r.text != want[r.doc_id]]
    assert wrong == []
    assert {r.doc_id: r.text for r in rows}[93] == want[93] == " As. \n"
    assert ld.digests(frame.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id long, text string").cache()
    plan = ld.digests(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_full_shingle_sets_of_lines_without_spaces(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices(kind, k=400)) for kind in ("0123456789abcdef", "天地玄黃宇宙洪荒日月盈昃辰宿列張", "abcdefghij/.-_?=𝒜𝒷")]
    near = [f"{x[:at]}z{x[at:]}" for x in base for at in (0, 40)]
    assert all(len(plain_set(x) & plain_set(y)) / len(plain_set(x) | plain_set(y)) > 0.9 for x, y in zip([b for b in base for _ in "ab"], near, strict=True))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*base, *near, "short", "a" * 9, "", "a" * 10 + "b"])], "doc_id long, text string")
    assert all(r.n == len(plain_set(r.text)) for r in rows.select("text", F.size(ld.shingles("text")).alias("n")).collect())
    kept = {r.doc_id: r.text for r in ld.dedup(rows).collect()}
    assert [kept[i] for i in range(3)] == base and all(kept[i] == "" for i in range(3, 9)) and kept[9] == "short"


def test_band_recall_by_length(spark):
    rng = random.Random(6)
    rows = []
    for n in (10, 20, 30, 50, 100, 300):
        for i in range(1000):
            common, mine, yours = ([rng.getrandbits(64) - (1 << 63) for _ in range(k)] for k in (8 * n // 10, n // 10, n // 10))
            rows.append((n, i, common + mine, common + yours))
    pairs = spark.createDataFrame(rows, "n int, i int, a array<long>, b array<long>").repartition(4)
    a, b = (ld.signed(pairs.select("n", "i", x), x).withColumnRenamed("bands", x) for x in "ab")
    found = a.join(b, ["n", "i"]).groupBy("n").agg(F.avg(F.arrays_overlap("a", "b").cast("int")).alias("hit"))
    hits = {r.n: r.hit for r in found.collect()}
    print(hits)
    assert len(hits) == 6 and min(hits.values()) >= 0.99


def test_recall_of_lines_by_length_and_repetition(spark):
    """Pairs of lines of a similarity a little above the threshold share a band, from the text on."""
    rng = random.Random(9)
    rows, pairs = [], {}
    for kind, make in (
        ("short", lambda: "".join(rng.choices("abcdefghij ", k=120))),
        ("long", lambda: "".join(rng.choices("abcdefghij ", k=900))),
        ("repetitive", lambda: "".join(rng.choices("abcdefghij ", k=70)) * 40),
        ("half", lambda: "".join(rng.choices("abcdefghij ", k=700)) + "=" * 3000),
    ):
        for i in range(60):
            line = make()
            at = rng.randrange(len(line) // 4, len(line) // 2)
            other = line[:at] + "Z" + line[at:] if kind != "long" else line[: len(line) // 2] + "Z" + line[len(line) // 2 :]
            if 100 * len(plain_set(line) & plain_set(other)) >= 80 * len(plain_set(line) | plain_set(other)):
                pairs.setdefault(kind, []).append((len(rows), len(rows) + 1))
                rows += [(len(rows), line), (len(rows) + 1, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in ld.dedup(docs).collect() if r.text == ""}
    found = {kind: sum(v in gone for _, v in each) / len(each) for kind, each in pairs.items()}
    print(found)
    assert len(found) == 4 and min(found.values()) >= 0.98


def test_clashing_columns_and_repeated_lines_of_one_character(spark):
    rows = [(1, "=" * 5000, "x", 1, 2), (2, "=" * 5001 + "\nown", "y", 3, 4), (None, "=" * 5000, "z", 5, 6), (3, None, "n", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _d int, t int")
    got = sorted((tuple(r) for r in ld.dedup(docs).collect()), key=str)
    assert got == sorted([(1, "=" * 5000, "x", 1, 2), (2, "own", "y", 3, 4), (None, "", "z", 5, 6), (3, None, "n", 7, 8)], key=str)


def test_buckets_are_compared_in_tiles(spark, monkeypatch):
    """Lines that share a long passage, and so bands, but are linked only in groups."""
    monkeypatch.setattr(ld, "TILE", 4)
    rng = random.Random(10)
    text = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = text(300)
    docs = []
    for g in range(12):
        own = text(150)
        docs += [(10 * g + i, passage + own + text(8)) for i in range(4)]
    want = brute(docs)
    assert {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_a_large_bucket_with_few_strays_takes_linear_work(spark, monkeypatch):
    monkeypatch.setattr(ld, "TILE", 32)
    rows = []
    keep = ld.dealt

    def counted(*a):
        out = keep(*a)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ld, "dealt", counted)
    rng = random.Random(11)
    base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(120))
    docs = [(i, near(rng, base, 1)) for i in range(300)]
    docs += [(1000 + i, base + " " + " ".join("".join(rng.choices("klmnop", k=6)) for _ in range(45))) for i in range(10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup(frame).collect()}
    assert got == brute(docs)
    # Sixteen buckets at most; a row for each member, and for each stray one with each tile of the others.
    assert rows[0] <= 16 * (300 * 2 + 10 * 60)
