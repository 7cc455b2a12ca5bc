import pytest
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions import vectors as V


def values(spark, column, rows, kind):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def python_line(x):
    s = x.strip()
    return len(s) >= 5 and sum(c.isalnum() for c in s) / len(s) >= 0.6


def test_valid_text(spark):
    rows = ["a" * 20, "a" * 21, "1" * 30, "東" * 21, "   " + "b" * 20 + "\n\t ", " " * 9 + "c" * 21, "", None]
    assert values(spark, T.is_valid_text, rows, "string") == [False, True, False, True, False, True, False, False]


def test_valid_line(spark):
    rows = ["## Page 9", "## Page 10", "| --- | --- |", "abcd", "abcde", "  ab  cd  ", "é東x1!", "!!!!!", ""]
    assert values(spark, T.is_valid_line, rows, "string") == [python_line(x) for x in rows]
    assert python_line(rows[0]) is False and python_line(rows[1]) is True


def test_distinct_lines(spark):
    assert values(spark, T.distinct_lines, [["A", "b", "a", "B", "c"], [], None], "array<string>") == [["A", "b", "c"], [], None]


def test_tables(spark):
    rows = [[["a", "b"]], [["a"], ["b"]], [["a", "1"], ["b", "2"]], [["a", "1"], ["1"]], [["a", None], ["b", "\n"]], [[None, "1"], ["2", "3"]], []]
    assert values(spark, T.is_valid_table, rows, "array<array<string>>") == [False, False, True, False, True, False, False]
    assert values(spark, T.table_markdown, [[["a", None], [" b\nc ", "d"]]], "array<array<string>>") == ["| a |  |\n| --- | --- |\n| b c | d |"]


def test_extension(spark):
    assert values(spark, T.extension, ["a/b.PDF", "nodot", "x.pdf.manifest.json", "a.tar.gz"], "string") == ["pdf", "nodot", "json", "gz"]


def test_clamp(spark):
    assert values(spark, lambda x: T.clamp_length(x, 100, 8192), [None, "0", "-5", "9000", "x", "42"], "string") == [100, 1, 1, 8192, 100, 42]
    assert values(spark, T.tokenizer_limit, [0, 512, 10**9], "long") == [8192, 512, 8192]


def test_seed_tokens(spark):
    assert values(spark, T.seed_tokens, ["The big, A of Zed"], "string") == [["the", "big,", "zed"]]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.l2(F.col("a"), F.col("b")), V.l2_normalize(F.col("a"))).collect()
    assert got[0][0] == 24 and got[0][1] == pytest.approx(0.96) and got[0][2] == pytest.approx(2**0.5) and got[0][3] == pytest.approx([0.6, 0.8])
    assert got[1][1] is None and got[1][3] == [0.0, 0.0]
    assert values(spark, lambda x: V.is_valid(x, 2), [[1.0, 2.0], [1.0], None], "array<float>") == [True, False, False]
    pooled = spark.sql("select array(array(1D, 2D), array(3D, 4D), array(9D, 9D)) h, array(1, 1, 0) m").select(V.masked_mean(F.col("h"), F.col("m"), 2)).first()[0]
    assert pooled == [2.0, 3.0]
    same = values(spark, lambda x: V.hashed_embedding(x, 16), [["a", "b"], ["a", "b"], []], "array<string>")
    assert same[0] == same[1] and sum(v * v for v in same[0]) == pytest.approx(1) and same[2] == [0.0] * 16
