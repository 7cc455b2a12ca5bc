"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors become unit vectors in the order of their principal directions. Range partitioning by label and
leading coordinate lays them out, and runs of neighbours become tiles with a box of their leading coordinates.
Two tiles are compared only if their boxes come close enough for a link. Within a pair of tiles the products
of the leading dimensions are summed first; the norms of the suffixes bound the rest, and pairs that cannot
reach the threshold are left before the next dimensions. Links are counted in the task, and each tile pair
hands on one count and one representative for a linked vector, never its pairs.

Vectors are compared if their labels are equal and not null and their lengths are equal. Vectors that are
null, empty or zero or hold null or non-finite components link with nothing, as do those with a null vec_id.
Repeated rows of a vec_id do not link with each other; each is returned, and their counts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import bound_batches, components, least_reached, written

#: Links have at least this cosine.
THRESHOLD = 0.93
#: Vectors of a tile, dimensions summed at a step, and leading coordinates of a tile's box.
TILE, STEP, BOX = 512, 16, 8
#: Tiles of a label whose boxes are compared in one group.
BOXES = 256
#: How near the threshold a rotated product must be to be computed again from the vectors as given.
NEAR = 1e-9
TILES = "tile string, label string, dim int, n long, low array<double>, high array<double>, ids binary, vectors binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label as text, dim and embedding of the vectors that can link."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)).select("vec_id", F.col("label").cast("string").alias("label"), F.size(e).alias("dim"), e.cast("array<double>").alias("embedding"))


def _units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, part in batch.groupby("dim"):
            units = _units(np.stack(part["embedding"].to_numpy()))
            sums[dim] = sums.get(dim, 0.0) + units.T @ units
    for dim, total in sums.items():
        yield pd.DataFrame({"dim": [dim], "sums": [total.ravel()]})


def directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The principal directions of each vector length, largest first; only sums of squares reach the driver."""
    parts = vectors.select("dim", "embedding").mapInPandas(_moments, "dim int, sums array<double>")
    each = parts.select("dim", F.posexplode("sums").alias("at", "s")).groupBy("dim", "at").agg(F.sum("s").alias("s"))
    rows = each.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums")).collect()
    return {r.dim: np.ascontiguousarray(np.linalg.eigh(np.array([x.s for x in r.sums]).reshape(r.dim, r.dim))[1][:, ::-1]) for r in rows}


def tiles(vectors: DataFrame, turns: dict[int, np.ndarray]) -> DataFrame:
    """The vectors in tiles of neighbours; a tile has one label."""
    shared = vectors.sparkSession.sparkContext.broadcast(turns)

    def lead(batch: pd.Series) -> pd.Series:
        return pd.Series([float(_units(x[None, :])[0] @ shared.value[len(x)][:, 0]) for x in map(np.asarray, batch)], dtype=float)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key, count = [], None, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and (key != (row.label, row.dim) or len(held) == TILE):
                    yield tile(held, key, count)
                    held, count = [], count + 1
                key = row.label, row.dim
                held.append((row.vec_id, row.embedding, row.part))
        if held:
            yield tile(held, key, count)

    def tile(held: list, key: tuple[str, int], count: int) -> pd.DataFrame:
        rows = np.stack([x[1] for x in held])
        box = _units(rows) @ shared.value[key[1]][:, :BOX]
        narrow = rows.astype(np.float32)  # without loss where the vectors were given so
        rows = narrow if (narrow == rows).all() else rows
        ids = np.array([x[0] for x in held], np.int64).tobytes()
        return pd.DataFrame({"tile": [f"{held[0][2]:08d}-{count:08d}"], "label": [key[0]], "dim": [key[1]], "n": [len(held)], "low": [box.min(0)], "high": [box.max(0)], "ids": [ids], "vectors": [rows.tobytes()]})

    placed = vectors.withColumn("lead", F.pandas_udf(lead, "double")("embedding"))
    ordered = placed.repartitionByRange("label", "dim", "lead", "vec_id").sortWithinPartitions("label", "dim", "lead", "vec_id")
    return ordered.select("vec_id", "label", "dim", "embedding", F.spark_partition_id().alias("part")).mapInPandas(cut, TILES)


def tile_pairs(tiled: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tile names whose boxes come near enough for a link; only names and boxes are joined."""
    most = 2 - 2 * threshold + 1e-6
    # The boxes of a large label are compared in several groups: each box of a is in one, each of b in all.
    groups = tiled.groupBy("label", "dim").agg(F.ceil(F.count("*") / BOXES).cast("int").alias("groups"))
    boxes = tiled.select("label", "dim", "tile", "low", "high").join(groups, ["label", "dim"])
    a = boxes.select("label", "dim", F.pmod(F.xxhash64("tile"), F.col("groups")).cast("int").alias("group"), F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    b = boxes.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    away = F.zip_with(F.zip_with("low_b", "high_a", lambda x, y: x - y), F.zip_with("low_a", "high_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    squares = F.aggregate(away, F.lit(0.0), lambda total, x: total + x * x)
    return a.join(b, ["label", "dim", "group"]).where((F.col("a") <= F.col("b")) & (squares <= most)).select("a", "b", "dim")


def linked(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b with a cosine of at least the threshold."""
    ua, ub = _units(a), _units(b)
    ya, yb = ua @ turn, ub @ turn
    dim = ya.shape[1]
    rest = lambda y, h: np.sqrt(np.maximum(0.0, (y[:, h:] ** 2).sum(1)))
    h = min(STEP, dim)
    total = ya[:, :h] @ yb[:, :h].T
    i, j = np.nonzero(total + np.outer(rest(ya, h), rest(yb, h)) >= threshold - NEAR)
    products = total[i, j]
    while h < dim and len(i):
        to = min(h + STEP, dim)
        if len(i) * 8 > total.size:  # many pairs are left: a whole product costs less than picking them out
            products = products + (ya[:, h:to] @ yb[:, h:to].T)[i, j]
        else:
            products = products + np.einsum("ij,ij->i", ya[i, h:to], yb[j, h:to])
        keep = products + rest(ya, to)[i] * rest(yb, to)[j] >= threshold - NEAR
        i, j, products = i[keep], j[keep], products[keep]
        h = to
    near = np.abs(products - threshold) < NEAR
    if near.any():
        # Scaled by powers of two, which rounds nothing and keeps squares finite.
        x, y = (np.ldexp(z, -np.frexp(np.abs(z).max(1, keepdims=True))[1]) for z in (a[i[near]], b[j[near]]))
        cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        products[near] = np.where(cosine >= threshold, 1.0, -1.0)
    keep = products >= threshold
    return i[keep], j[keep]


def compare(pairs: DataFrame, tiled: DataFrame, turns: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(vec_id, n, root): links of each linked vector in a tile pair and a vector it reaches there."""
    shared = tiled.sparkSession.sparkContext.broadcast(turns)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids_a, ids_b = np.frombuffer(row.ids_a, np.int64), np.frombuffer(row.ids_b, np.int64)
                a, b = (np.frombuffer(x, np.float32 if len(x) < len(ids) * row.dim * 8 else np.float64).reshape(-1, row.dim).astype(np.float64) for x, ids in ((row.vectors_a, ids_a), (row.vectors_b, ids_b)))
                i, j = linked(a, b, shared.value[row.dim], threshold)
                keep = ids_a[i] != ids_b[j]
                if row.a == row.b:
                    keep &= i < j
                ids, at = np.unique(np.concatenate([ids_a[i[keep]], ids_b[j[keep]]]), return_inverse=True)
                if len(ids):
                    u, v = at[: keep.sum()], at[keep.sum() :]
                    yield pd.DataFrame({"vec_id": ids, "n": np.bincount(at, minlength=len(ids)), "root": ids[least_reached(len(ids), u, v)]})

    blobs = [tiled.select(F.col("tile").alias(x), F.col("ids").alias(f"ids_{x}"), F.col("vectors").alias(f"vectors_{x}")) for x in "ab"]
    return pairs.join(blobs[0], "a").join(blobs[1], "b").mapInPandas(each, "vec_id long, n long, root long")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    bound_batches(vectors.sparkSession)
    able = usable(vectors)
    turns = directions(able)
    tiled, _ = written(tiles(able, turns))
    found, _ = written(compare(tile_pairs(tiled, threshold), tiled, turns, threshold))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    reached = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))).toDF("vec_id", "component_id")
    out = vectors.select("vec_id").join(counts, "vec_id", "left").join(reached, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of dedup() over the table embeddings."""
    d = "list_dot_product({0}.e, {1}.e)"
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE {d.format("a", "b")} / (sqrt({d.format("a", "a")}) * sqrt({d.format("b", "b")})) >= {threshold}::DOUBLE),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, least(u, min(v)) AS c FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""
