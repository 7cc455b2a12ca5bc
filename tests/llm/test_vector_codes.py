"""Vector codes against a full scan in plain Python integers, and against their SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from fathom.llm import vector_codes as c

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int"


def plain(rows, rounds=c.ROUNDS):
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    able = sorted((i, v) for i, v, _ in kept if i is not None and v and len(v) % 8 == 0)
    if not able:
        return sorted((str(i), "None", "None", "None") for i, _, _ in kept)
    n = len(able[0][1])
    first = {}
    for i, v in able:
        if len(v) == n:
            first.setdefault(i, v)
    cut = lambda v: [v[p * n // 8 : (p + 1) * n // 8] for p in range(8)]
    books = [[cut(v)[p] for _, v in sorted(first.items())[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    fit = [(i, cut(v), y) for i, v, y in kept if len(v) == n]
    for _ in range(rounds):
        for p in range(8):
            own = [near(v[p], books[p])[1] for _, v, _ in fit]
            for j in range(len(books[p])):
                mine = [v[p] for (_, v, _), o in zip(fit, own) if o == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = [(i, y, *zip(*(near(v[p], books[p]) for p in range(8)))) for i, v, y in fit]
    by = {}
    for _, y, d, _ in out:
        by[y] = by.get(y, 0) + sum(d)
    rest = [(str(i), "None", "None", str(by.get(y))) for i, v, y in kept if len(v) != n]
    return sorted([(str(i), "".join(f"{j:02x}" for j in code), str(sum(d)), str(by[y])) for i, y, d, code in out] + rest), sha


def run(spark, rows):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA).repartition(3)
    got = c.compress(df).collect()
    return sorted((str(r.vec_id), str(r.code), str(r.error), str(r.label_error)) for r in got), {r.codebooks_sha256 for r in got}


def vectors(n, seed, spread=0.3, dim=64):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(20, dim))
    return [(i, (middle[rng.integers(20)] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(4)) if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0, 0.3])
def test_equals_a_full_scan(spark, spread):
    rows = vectors(250, 1, spread)
    want, sha = plain(rows)
    assert run(spark, rows) == (want, {sha})


def test_nulls_lengths_repeats_and_ties(spark):
    rows = vectors(40, 2)
    rows += [rows[0]] * 30 + [(3, rows[5][1], 1), (None, rows[1][1], None), (50, None, 1), (51, [], 1), (52, [1.0] * 63, 9), (53, [math.nan] * 64, 1), (54, [math.inf] * 64, 1), (55, [None] * 64, 1), (56, [1.0] * 32, 2), (-1, [1.0] * 7, 2), (57, [0.5] * 64, None)]
    want, sha = plain(rows)
    assert run(spark, rows) == (want, {sha})
    assert len(run(spark, [*rows, (90, [3e38] * 64, 1)])[0]) == len(want) + 1


def test_few_and_no_rows(spark):
    for n in (1, 5):
        want, sha = plain(vectors(n, 3))
        assert run(spark, vectors(n, 3)) == (want, {sha})
    assert run(spark, [])[0] == []
    assert run(spark, [(1, [1.0] * 3, 1), (2, None, 1)])[0] == [("1", "None", "None", "None")]


@pytest.mark.parametrize("keep", [1, 2, 4, 16])
def test_bounds_find_the_nearest_with_few_distances(keep):
    rng = np.random.default_rng(keep)
    points = np.floor(rng.normal(size=(3000, 8)) * 40).astype(np.int64)
    book = points[:16].copy()
    near, bounds = c.scan(points, book, keep)
    worked = []
    for n in range(6):
        d = ((points[:, None] - book) ** 2).sum(2)
        assert (near[:, 0] == d.argmin(1)).all()
        assert (bounds[:, 0] >= np.sqrt(d.min(1)) * (1 - 1e-9)).all()
        for i in range(1, keep):
            assert (bounds[:, i] <= np.sqrt(d[np.arange(len(d)), near[:, i]]) * (1 + 1e-9)).all()
        rest = d.astype(float)
        np.put_along_axis(rest, near.astype(int), np.inf, 1)
        assert (bounds[:, keep] <= np.sqrt(rest.min(1)) * (1 + 1e-9)).all()
        after = book.copy()
        for j in np.unique(near[:, 0]):
            after[j] = points[near[:, 0] == j].sum(0) // (near[:, 0] == j).sum()
        near, bounds, depth = c.reassign(points, after, book, near, bounds)
        book = after
        worked.append(np.where(depth > keep, 16, depth).mean())
    assert keep == 1 or worked[-1] < 8


def test_entries_kept_are_adapted():
    counts = np.zeros((3, 18), int)
    counts[0, 1:4] = 900, 99, 1
    counts[1, 4], counts[1, 5] = 1000, 500
    assert c.adapted([4, 4, 4], counts, 16) == [2, 4, 4]
    near, bounds = c.narrowed(np.array([[3, 1, 2]]), np.array([[1.0, 2.0, 3.0, 2.5]]), 2)
    assert near.tolist() == [[3, 1]] and bounds.tolist() == [[1.0, 2.0, 2.5]]


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = con.sql(c.oracle()).df()
    got = c.compress(spark.read.parquet(f"{DIR}/embeddings.parquet")).toPandas()
    assert sorted(map(tuple, got[list(want.columns)].values)) == sorted(map(tuple, want.values))
