"""Centroid clustering in whole numbers with ns-bounds.

Every vector keeps, for each centroid, the squared distance of their last meeting and the round of it; the history
of all centroids is retained. In a later round a stored distance is loosened by the norm of the centroid's total
displacement since that round, which is never more than the sum of its steps. A vector is left alone where even its
loosened own distance stays below all loosened others; else its own distance is worked out anew, and then those of
the centroids that still may be as near. All that is worked out is exact, so the result is that of a full scan.

A round reads the table of the one before and writes its own in the shared folder; sums of components, one row for
a centroid, are all that reaches the driver.

Vectors that are null, do not have COMPONENTS components or hold null or non-finite ones are dropped. With fewer
vectors than CENTROIDS each is a centroid; of an empty table nothing is returned. Repeated rows count as vectors of
their own. Rows of a null vec_id are clustered, and are the last to be a start; equal ids go by their components.
Components beyond 2**27 count as that; a sum of distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import bound_batches, removed, written
from fathom.llm.whole_vectors import SLACK, all_finite, displacement, floors, lists, matrix, squares

#: Components of a vector, and what they are multiplied by.
COMPONENTS, SCALE = 64, 64
#: Centroids, and rounds in which they move.
CENTROIDS, ROUNDS = 16, 3
STATE = "vec_id long, point array<int>, cluster int, distance long, met array<long>, round array<byte>"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and point, the whole components, of the vectors that are clustered."""
    kept = vectors.where(all_finite("embedding") & (F.size("embedding") == COMPONENTS))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), floors("embedding", SCALE).alias("point"))


def starts(points: DataFrame, centroids: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the hashes' order."""
    place = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = points.orderBy(place.asc_nulls_last(), "point").limit(centroids).collect()
    return np.array([r.point for r in first], np.int64).reshape(len(first), COMPONENTS)


def nearest(points: np.ndarray, own: np.ndarray | None, met: np.ndarray | None, since: np.ndarray | None, history: np.ndarray, tight: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest of the last centroids of a history for each point, what is remembered of all, and how many distances were worked out.

    own, met and since are the result of an earlier round, or None in the first. If tight, own distances are up to date.
    """
    n, k, now = len(points), history.shape[1], len(history) - 1
    rows = np.arange(n)
    if own is None:
        met = np.stack([squares(points, c) for c in history[-1]], 1)
        return met.argmin(1), met, np.zeros((n, k), np.int8), n * k
    own, met, since, worked = own.copy(), met.copy(), since.copy(), 0

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal worked
        met[i, j], since[i, j] = squares(points[i], history[-1][j]), now
        worked += len(i)

    drift = displacement(history, history[-1])  # by round of the last meeting, then centroid
    away = drift[since, np.arange(k)]
    root = np.sqrt(met)
    low = root * (1 - SLACK) - away
    low[rows, own] = np.inf
    unsure = np.nonzero(low.min(1) <= root[rows, own] * (1 + SLACK) + away[rows, own])[0]
    again = rows if tight else unsure
    meet(again, own[again])
    at, j = np.nonzero(low[unsure] <= np.sqrt(met[unsure, own[unsure]])[:, None] * (1 + SLACK))
    meet(unsure[at], j)
    # Centroids that were not met in this round are farther than the own one; equal distances go to the smaller number.
    fresh = np.where(since[unsure] == now, met[unsure], np.iinfo(np.int64).max)
    own[unsure] = fresh.argmin(1)
    return own, met, since, worked


def _round(history: np.ndarray, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = history.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("point"), COMPONENTS, np.int64)
            before = (None, None, None)
            if len(history) > 1:
                before = batch.column("cluster").to_numpy(), matrix(batch.column("met"), k, np.int64), matrix(batch.column("round"), k, np.int8)
            own, met, since, _ = nearest(points, *before, history, last)
            columns = [batch.column("vec_id"), batch.column("point"), pa.array(own.astype(np.int32)), pa.array(met[np.arange(len(own)), own]), lists(met), lists(since)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "point", "cluster", "distance", "met", "round"])

    return step


def moved(centroids: np.ndarray, state: DataFrame) -> np.ndarray:
    """The centroids of the next round: floors of the means of their vectors; those without vectors stay."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("point", F.lit(i))) for i in range(COMPONENTS))).alias("sums")).collect()
    after = centroids.copy()
    for row in sums:
        after[row.cluster] = [s // row.n for s in row.sums]
    return after


def digest(components: np.ndarray) -> str:
    """The hash of whole numbers in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, components.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is clustered."""
    spark = vectors.sparkSession
    bound_batches(spark)
    state, path = written(usable(vectors))
    history = starts(state, centroids)[None]
    if not history.size:
        return spark.createDataFrame([], RESULT)
    for number in range(rounds + 1):
        after, after_path = written(state.mapInArrow(_round(history, number == rounds), STATE))
        removed(spark, path)
        state, path = after, after_path
        if number < rounds:
            history = np.concatenate([history, moved(history[-1], state)[None]])
    state = state.select("vec_id", "cluster", "distance")
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    long = lambda s: int(s) if s < 1 << 63 else None
    whole = long(sum(r.s for r in sums))
    # One row for a centroid.
    of = spark.createDataFrame([(r.cluster, long(r.s), whole, digest(history[-1][r.cluster])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of cluster() over the table embeddings, for components within the bound."""
    parts = [
        f"""p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS p FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, p) - 1 AS j, p AS c FROM p QUALIFY j < {centroids})",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, p, vec_id, j, list_dot_product(p, p) - 2 * list_dot_product(p, c) + list_dot_product(c, c) AS d FROM p CROSS JOIN c{n})")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(p) AS p, arg_min(j, d * {centroids} + j) AS j, min(d)::BIGINT AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT j, i, floor(sum(x) / count(*)) AS m FROM (SELECT j, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM a{n}) GROUP BY ALL)")
            parts.append(f"m{n} AS (SELECT j, list(m ORDER BY i) AS c FROM s{n} GROUP BY j)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.j, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON m{n}.j = c{n}.j)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""
