"""Vector code compression: product codes trained and assigned in whole numbers with Drake-Hamerly adaptive bounds.

A vector is cut into PARTS parts, and each part position has a codebook. For each part of each vector a few closest
entries are persisted in order, with an upper bound of the distance to the first, ordered lower bounds of those to
the others, and one outer bound for all entries that are not among them. Entries move; their displacements loosen the
bounds. Where the upper bound is below a lower one, all entries from there on are farther, and only those before it
are worked out anew, in whole numbers, and put in order; where it is not even below the outer bound, all entries are.
How many entries are kept is adapted after each round, for each part position, to what nearly all parts needed.

A round reads the table of the one before and writes its own in the shared folder; sums of components, one row for an
entry, and counts of the entries needed are all that reaches the driver.

Vectors that are null or hold null or non-finite components are dropped. Vectors have the length of that of the
smallest vec_id whose length is a positive multiple of PARTS; others are returned without code and error. Rows of one
vec_id have codes of their own; a codebook starts with the least vector of each of the ENTRIES smallest ids, nulls
aside, or of as many as there are. Of an empty table nothing is returned. Components beyond 2**27 (of vectors of 64
components) count as that; a sum of errors beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import bound_batches, removed, written
from fathom.llm.whole_vectors import SLACK, all_finite, displacement, floors, matrix, squares

#: Parts of a vector, entries of a codebook, rounds in which entries move, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Of the parts that bounds decide, so many may need more entries than are kept, in hundredths.
BEYOND = 1
STATE = "vec_id long, label string, point array<int>, near binary, bounds binary, depth binary, errors binary"
SUMS = "part int, entry int, n long, sums array<long>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label as text, and point, the whole components, of the vectors that are kept."""
    label = F.col("label").cast("string").alias("label")
    return vectors.where(all_finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), label, floors("embedding", SCALE).alias("point"))


def starts(points: DataFrame) -> np.ndarray:
    """The first entries, by part, then entry; no rows if no vector can be cut."""
    able = points.where((F.size("point") > 0) & (F.size("point") % PARTS == 0) & F.col("vec_id").isNotNull())
    first = able.orderBy("vec_id", "point").select(F.size("point").alias("n")).first()
    if first is None:
        return np.zeros((PARTS, 0, 0), np.int64)
    able = able.where(F.size("point") == first.n)
    ids = [r.vec_id for r in able.select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    rows = able.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("point").alias("point")).orderBy("vec_id").collect()
    return np.array([r.point for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2)


def scan(points: np.ndarray, book: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The closest entries in order and their bounds, from the distances to all entries: (near, bounds).

    The first bound is the upper one of the first entry, the last the outer one.
    """
    d = np.stack([squares(points, c) for c in book], 1)
    order = np.argsort(d, 1, kind="stable")
    root = np.sqrt(np.take_along_axis(d, order, 1))
    outer = root[:, keep : keep + 1] if keep < len(book) else np.full((len(points), 1), np.inf)
    return order[:, :keep].astype(np.uint8), np.concatenate([root[:, :keep], outer], 1)


def reassign(points: np.ndarray, book: np.ndarray, before: np.ndarray, near: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near and bounds after the entries moved from before to book, and how many entries each part needed; one more than are kept if all."""
    near, bounds = near.copy(), bounds.copy()
    n, keep = near.shape
    moved = displacement(book, before)
    others = np.broadcast_to(moved, (n, len(book))).copy()
    np.put_along_axis(others, near.astype(int), 0.0, 1)
    bounds[:, 0] = bounds[:, 0] * (1 + SLACK) + moved[near[:, 0]]
    bounds[:, 1:keep] = bounds[:, 1:keep] * (1 - SLACK) - moved[near[:, 1:]]
    bounds[:, keep] = bounds[:, keep] * (1 - SLACK) - others.max(1)
    bounds[:, 1:] = np.minimum.accumulate(bounds[:, :0:-1], 1)[:, ::-1]

    def needed(rows: np.ndarray) -> np.ndarray:
        # The first lower bound above the upper one; bounds that are too close to tell count as reached.
        above = bounds[rows, 1:] * (1 - SLACK) > bounds[rows, :1] * (1 + SLACK)
        return np.where(above.any(1), above.argmax(1) + 1, keep + 1)

    depth = needed(np.arange(n))
    unsure = np.nonzero(depth > 1)[0]
    bounds[unsure, 0] = np.sqrt(squares(points[unsure], book[near[unsure, 0]]))
    depth[unsure] = needed(unsure)
    for some in range(2, keep + 1):
        rows = np.nonzero(depth == some)[0]
        if len(rows):
            d = np.stack([squares(points[rows], book[near[rows, i]]) for i in range(some)], 1)
            order = np.lexsort((near[rows, :some], d), 1)  # by distance, then entry
            near[rows, :some] = np.take_along_axis(near[rows, :some], order, 1)
            bounds[rows, :some] = np.sqrt(np.take_along_axis(d, order, 1))
    rows = np.nonzero(depth > keep)[0]
    if len(rows):
        near[rows], bounds[rows] = scan(points[rows], book, keep)
    return near, bounds, depth


def narrowed(near: np.ndarray, bounds: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The first entries only; the bounds of the others become part of the outer one."""
    if keep == near.shape[1]:
        return near, bounds
    return near[:, :keep], np.concatenate([bounds[:, :keep], bounds[:, keep:].min(1, keepdims=True)], 1)


def adapted(keep: list[int], counts: np.ndarray, entries: int) -> list[int]:
    """How many entries each part position keeps, from counts of the parts by the entries that they needed.

    Never more than before, and an eighth of the entries at least.
    """
    out = []
    for now, part in zip(keep, counts, strict=True):
        decided = part[1 : now + 1]
        enough = np.nonzero(np.cumsum(decided) * 100 >= decided.sum() * (100 - BEYOND))[0]
        out.append(min(now, max(entries // 8, 1, int(enough[0]) + 1)) if decided.any() else now)
    return out


def _cut(data: list[bytes | None], sizes: list[int], kind: type) -> list[np.ndarray]:
    rows = np.frombuffer(b"".join(data), kind).reshape(len(data), sum(sizes))
    return np.split(rows, np.cumsum(sizes)[:-1], 1)


def _bytes(parts: list[np.ndarray], kind: type) -> pa.Array:
    rows = np.ascontiguousarray(np.concatenate(parts, 1), kind)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _round(books: list[np.ndarray], stored: list[int], keep: list[int], last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = books[-1].shape[2]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("point"), PARTS * width, np.int64).reshape(-1, PARTS, width)
            first = len(books) == 1
            if not first:
                near_before = _cut(batch.column("near").to_pylist(), stored, np.uint8)
                bounds_before = _cut(batch.column("bounds").to_pylist(), [k + 1 for k in stored], np.float64)
            nears, bounds, depths, errors = [], [], [], []
            for p in range(PARTS):
                x, book = points[:, p], books[-1][p]
                if first:
                    near, bound = scan(x, book, keep[p])
                    depth = np.full(len(x), keep[p] + 1)
                else:
                    near, bound, depth = reassign(x, book, books[-2][p], *narrowed(near_before[p], bounds_before[p], keep[p]))
                nears.append(near)
                bounds.append(bound)
                depths.append(depth[:, None])
                errors.append(squares(x, book[near[:, 0]])[:, None] if last else np.zeros((len(x), 0), np.int64))
            columns = [batch.column(c) for c in ("vec_id", "label", "point")]
            yield pa.RecordBatch.from_arrays([*columns, _bytes(nears, np.uint8), _bytes(bounds, np.float64), _bytes(depths, np.uint8), _bytes(errors, np.int64)], ["vec_id", "label", "point", "near", "bounds", "depth", "errors"])

    return step


def _totals(keep: list[int], entries: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of SUMS of a task: sums of each entry's parts; under the entry -1 counts of parts by needed entries."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        depths = np.zeros((PARTS, entries + 2), np.int64)
        for batch in batches:
            points = matrix(batch.column("point"), PARTS * width, np.int64).reshape(-1, PARTS, width)
            near = _cut(batch.column("near").to_pylist(), keep, np.uint8)
            depth = _cut(batch.column("depth").to_pylist(), [1] * PARTS, np.uint8)
            for p in range(PARTS):
                np.add.at(sums[p], near[p][:, 0], points[:, p])
                counts[p] += np.bincount(near[p][:, 0], minlength=entries)
                depths[p] += np.bincount(depth[p][:, 0], minlength=entries + 2)
        rows = [(p, e, int(counts[p, e]), sums[p, e].tolist()) for p in range(PARTS) for e in range(entries) if counts[p, e]]
        rows += [(p, -1, 0, depths[p].tolist()) for p in range(PARTS)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "entry", "n", "sums"])

    return step


def totals(state: DataFrame, keep: list[int], entries: int, width: int) -> tuple[dict[tuple[int, int], tuple[int, list[int]]], np.ndarray]:
    """Number and sums of the parts of each entry, by part and entry, and the counts of parts by needed entries."""
    each = state.select("point", "near", "depth").mapInArrow(_totals(keep, entries, width), SUMS)
    ends = max(width, entries + 2)
    summed = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(ends))).alias("sums")).collect()
    counts = np.zeros((PARTS, entries + 2), np.int64)
    for r in summed:
        if r.entry < 0:
            counts[r.part] = r.sums[: entries + 2]
    return {(r.part, r.entry): (r.n, r.sums[:width]) for r in summed if r.entry >= 0}, counts


def moved(book: np.ndarray, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> np.ndarray:
    """The codebooks of the next round: floors of the means; entries without parts stay."""
    after = book.copy()
    for (part, entry), (n, total) in sums.items():
        after[part, entry] = [s // n for s in total]
    return after


def digest(books: np.ndarray) -> str:
    """The hash of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    bound_batches(spark)
    points, points_path = written(usable(vectors))
    books = [starts(points)]
    _, entries, width = books[0].shape
    codes = points.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if entries:
        state, path = points.where(F.size("point") == PARTS * width), None
        stored = keep = [max(entries // 4, 1)] * PARTS
        for number in range(rounds + 1):
            after, after_path = written(state.mapInArrow(_round(books[-2:], stored, keep, number == rounds), STATE))
            if path:
                removed(spark, path)
            state, path, stored = after, after_path, keep
            if number < rounds:
                sums, counts = totals(state, keep, entries, width)
                books.append(moved(books[-1], sums))
                if number:  # in the first round all parts need all entries
                    keep = adapted(keep, counts, entries)
        result = _results(stored)
        coded = state.select("vec_id", "label", "near", "errors").mapInArrow(result, "vec_id long, label string, code string, error long")
        codes = coded.unionByName(codes.where(F.size(points["point"]) != PARTS * width))
    codes, _ = written(codes)
    removed(spark, points_path)
    if entries:
        removed(spark, path)
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("s")).select(F.col("label").alias("l"), F.expr("try_cast(s as bigint)").alias("label_error"))
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books[-1])).alias("codebooks_sha256"))


def _results(keep: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.concatenate([x[:, :1] for x in _cut(batch.column("near").to_pylist(), keep, np.uint8)], 1)
            errors = np.concatenate(_cut(batch.column("errors").to_pylist(), [1] * PARTS, np.int64), 1).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in near], pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return step


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of compress() over the table embeddings, for vectors of one length and components within the bound."""
    parts = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS p FROM k CROSS JOIN (SELECT unnest(range({PARTS})) AS part))",
        f"o AS (SELECT vec_id, arg_min(r, v) AS r FROM k WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {ENTRIES})",
        "c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, p AS c FROM o JOIN p USING (r))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, part, p, e, list_dot_product(p, p) - 2 * list_dot_product(p, c) + list_dot_product(c, c) AS d FROM p JOIN c{n} USING (part))")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, part, any_value(p) AS p, arg_min(e, d * {ENTRIES} + e) AS e, min(d)::BIGINT AS d FROM d{n} GROUP BY r, part)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT part, e, i, floor(sum(x) / count(*)) AS m FROM (SELECT part, e, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM a{n}) GROUP BY ALL)")
            parts.append(f"m{n} AS (SELECT part, e, list(m ORDER BY i) AS c FROM s{n} GROUP BY ALL)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m{n}.c, b.c) AS c FROM c{n} b LEFT JOIN m{n} ON m{n}.part = b.part AND m{n}.e = b.e)")
    parts.append(f"f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    parts.append(f"b AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS h FROM c{rounds})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM f JOIN k USING (r) CROSS JOIN b"""
