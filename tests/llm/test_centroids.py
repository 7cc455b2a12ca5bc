"""Centroid clustering against a full scan in plain Python integers, and against its SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from fathom.llm import centroids as c

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k=c.CENTROIDS, rounds=c.ROUNDS):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [list(v) for _, v in sorted(kept, key=key)[:k]]
    for n in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(cents)) for _, v in kept]
        if n < rounds:
            for j in range(len(cents)):
                mine = [v for (_, v), (_, o) in zip(kept, own) if o == j]
                if mine:
                    cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    total = sum(d for d, _ in own)
    return sorted((str(i), j, d, sum(x for x, o in own if o == j), total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own))


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in c.cluster(df).collect())


def vectors(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(20, 64))
    return [(i, (middle[rng.integers(20)] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_equals_a_full_scan(spark, spread):
    rows = vectors(300, 1, spread)
    assert run(spark, rows) == plain(rows)


def test_nulls_lengths_repeats_and_large_components(spark):
    rows = vectors(60, 2)
    rows += [rows[0]] * 40 + [(None, rows[1][1]), (None, None), (70, None), (71, []), (72, [1.0] * 63), (73, [math.nan] * 64), (74, [math.inf] + [0.0] * 63), (75, [None] + [0.0] * 63), (76, [-0.001] * 64), (77, [0.0] * 64)]
    assert run(spark, rows) == plain(rows)
    assert len(run(spark, [*rows, (80, [3e38] * 64)])) == len(plain(rows)) + 1


def test_few_and_no_rows(spark):
    assert run(spark, vectors(3, 3)) == plain(vectors(3, 3))
    assert run(spark, []) == run(spark, [(1, None)]) == []


def test_bounds_spare_most_distances():
    points = np.floor(64 * np.array([v for _, v in vectors(4000, 4, 0.1)])).astype(np.int64)
    history, state, worked = points[None, :16], (None, None, None), []
    for n in range(6):
        own, met, since, count = c.nearest(points, *state, history, n == 5)
        d = ((points[:, None] - history[-1]) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        assert (met[np.arange(len(own)), own] == d.min(1))[since[np.arange(len(own)), own] == n].all()
        state, worked = (own, met, since), [*worked, count]
        after = history[-1].copy()
        for j in np.unique(own):
            after[j] = points[own == j].sum(0) // (own == j).sum()
        history = np.concatenate([history, after[None]])
    assert (since[np.arange(len(own)), own] == 5).all()
    assert sum(worked[1:]) < worked[0] * 5 / 3


def test_the_norm_of_the_total_displacement_is_no_more_than_the_sum_of_steps():
    history = np.cumsum(np.random.default_rng(5).integers(-9, 9, (5, 16, 64)), 0)
    steps = sum(c.displacement(a, b) for a, b in zip(history, history[1:]))
    assert (c.displacement(history[0], history[-1]) < steps).all()


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = con.sql(c.oracle()).df()
    got = c.cluster(spark.read.parquet(f"{DIR}/embeddings.parquet")).toPandas()
    assert sorted(map(tuple, got[list(want.columns)].values)) == sorted(map(tuple, want.values))
