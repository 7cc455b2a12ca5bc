import random

from fathom.llm import packing


def brute(pieces, lengths, cost):
    """Every open bin looked at for each piece."""
    room, bins, filled = [], [], []
    for i, n in enumerate(pieces):
        fits = [(r, k) for k, r in enumerate(room) if r >= n and r > 0]
        if fits:
            k = min(fits)[1]
        else:
            sizes = [s for s in lengths if s >= n]
            use = lambda s: min(s, n + sum(x for x in pieces[i + 1 :] if x <= s - n))
            size = min(sizes, key=lambda s: ((cost + s) / use(s), s))
            k = len(room)
            room.append(size)
            filled.append(0)
        room[k] -= n
        filled[k] += n
        bins.append(k)
    return bins, [min(s for s in lengths if s >= f) for f in filled]


def test_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        pieces = sorted((min(64, int(rng.expovariate(0.08)) + 1) for _ in range(rng.randint(0, 70))), reverse=True)
        bins, positions, capacities = packing.pack(pieces, (8, 16, 32, 64), 3)
        assert (bins, capacities) == brute(pieces, (8, 16, 32, 64), 3)
        for k, capacity in enumerate(capacities):
            inside = sorted((p, n) for b, p, n in zip(bins, positions, pieces, strict=True) if b == k)
            assert all(p + n == q for (p, n), (q, _) in zip(inside, inside[1:], strict=False)) and sum(inside[-1]) <= capacity


def test_every_word_is_packed_once_on_odd_rows(spark):
    texts = [None, "", " \n\t ", "one", "one", "word " * 10_000, "a b c d e", "x " * 256, "y " * 257]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "one", ""), (None, "p q", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string")
    placed = packing.best_fit(docs)
    out = placed.collect()
    for i, text in enumerate(texts):
        mine = sorted((r.start, r.n_tokens) for r in out if r.doc_id == i)
        assert sum(n for _, n in mine) == len((text or "").split()) * (2 if i == 3 else 1)
        if text and len(text.split()) > 4096:
            assert [s for s, _ in mine] == [0, 4096, 8192]
    assert all((r.bin is None) == (r.n_tokens == 0) for r in out) and any(r.doc_id is None and r.n_tokens == 2 for r in out)
    sequences = packing.with_texts(docs.dropDuplicates(), placed.dropDuplicates()).collect()
    assert all(len(s.text.split()) == s.n_tokens <= s.capacity for s in sequences)
    assert packing.best_fit(docs.where("false")).count() == 0


def test_waste_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.best_fit(docs)
    used = out.groupBy().sum("n_tokens").first()[0]
    paid = out.where("bin is not null").select("shard", "bin", "capacity").distinct().groupBy().sum("capacity").first()[0]
    assert used / paid > 0.97


def test_equal_rows_spread_over_shards(spark):
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 7L, id) as doc_id", "if(id % 2 = 0, 'a b', concat('c ', id)) as text")
    shards = packing.best_fit(rows).groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == 40_000
    assert len(shards) == 10 and max(r["count"] for r in shards) < 1.2 * packing.SHARD_DOCS
