import numpy as np

from fathom.llm import embed_dedup as ed
from tests.llm.test_common import plain


def brute(rows, threshold=ed.THRESHOLD):
    ids = [r[0] for r in rows]
    good = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, edges = dict.fromkeys(ids, 0), []
    for i, (a, x, k, *_) in enumerate(good):
        for b, y, m, *_ in good[i + 1 :]:
            if a != b and k == m and len(x) == len(y):
                p, q = np.array(x, float), np.array(y, float)
                if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    edges.append((a, b))
    reach = plain(edges)
    return sorted(((i, links[i], reach.get(i, i), i == reach.get(i, i)) for i in ids), key=str)


def test_equals_brute_force_on_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 24))
    rows = [(i, [float(np.float32(v)) for v in base[i % 12] + 0.16 * rng.normal(size=24)], int(i % 3)) for i in range(220)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 24, 1), (303, [float("nan")] + [1.0] * 23, 1), (304, [None] + [1.0] * 23, 1), (305, rows[0][1], None), (306, rows[0][1], 0), (307, rows[0][1], 0), (308, [1.0, 0.0], 0), (309, [1.0, 0.1], 0), (310, [float("inf")] * 24, 2)]
    rows += [(306, rows[0][1], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, n long")
    got = sorted(map(tuple, ed.dedup(df).collect()), key=str)
    want = [(i, n, c, True if i is None else k) for i, n, c, k in brute(rows)]
    assert got == sorted(want, key=str)
    assert ed.dedup(df.where("false")).count() == 0


def test_linked_equals_whole_products():
    rng = np.random.default_rng(1)
    for spread in (0.05, 0.2, 1.0):
        a, b = (rng.normal(size=64) + spread * rng.normal(size=(90, 64)) for _ in range(2))
        b[:40] = a[:40] + 0.1 * rng.normal(size=(40, 64))
        turn = np.linalg.eigh(ed._units(a).T @ ed._units(a))[1][:, ::-1]
        want = np.nonzero(ed._units(a) @ ed._units(b).T >= 0.93)
        got = ed.linked(a, b, turn, 0.93)
        assert sorted(zip(*got, strict=True)) == sorted(zip(*want, strict=True))


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in df.collect()]
    assert sorted(map(tuple, ed.dedup(df).collect()), key=str) == brute(rows)
