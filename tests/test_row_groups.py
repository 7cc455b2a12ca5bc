"""Row groups by size: the rounds of jobs do not grow with the rows, and runs longer than a range stay whole."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import chunkers


def plain(rows, per_chunk, least):
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((i, n or 0) for x, i, n in rows if x == g)
        size, chunk, total = max(least, per_chunk * sum(n for _, n in mine) / len(mine)), 0, 0
        for i, n in mine:
            want[g, i] = chunk
            total += n
            if total >= size:
                chunk, total = chunk + 1, 0
    return want


@pytest.mark.parametrize("least,lengths", [(1, [0, 1, 3]), (50, [0, 1, 5, 40, 300]), (100000, [0, 1, 5, 40, 300]), (7, [0, 0, 0, 9])])
def test_equals_a_fold_over_ranges(spark, least, lengths):
    rng = random.Random(least)
    rows = [(f"g{g}", i, rng.choice(lengths)) for g in range(3) for i in range(400 * g + 1)] + [("z", 1, None)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(4)
    got = {(r.g, r.i): r.chunk for r in chunkers.sized_row_groups(df, "g", "i", F.col("n"), 3, least).collect()}
    assert got == plain(rows, 3, least)


def test_number_of_tables_written_is_fixed(spark, monkeypatch):
    made, write = [], chunkers.written
    monkeypatch.setattr(chunkers, "written", lambda df: made.append(1) or write(df))
    counts = []
    for n in (10, 3000):
        made.clear()
        df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("i"), F.lit(1).alias("n"))
        assert chunkers.sized_row_groups(df, "g", "i", F.col("n"), 1, 2).agg(F.max("chunk")).first()[0] == (n - 1) // 2
        counts.append(len(made))
    assert counts[0] == counts[1]
