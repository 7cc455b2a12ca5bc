"""A trained vector index: k-means cells, product codes of residuals, a table laid out by cell, exact re-ranking.

Cells and codebooks are fitted to a bounded sample; every vector is indexed. A search looks into the nearest cells of
each query: tiles of cells meet blocks of queries, the vectors that the codes stand for are scored first, and exact
products are computed for a tile's short list only.

A vector lies in its COPIES nearest cells, so that a query need not look into all cells around it.

Vectors that are null, empty or hold null or non-finite components, or have another length than the first of the
sample, are not indexed. Repeated rows are indexed each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.lexical import top

#: Vectors that cells and codebooks are fitted to, at most; rounds of their fit; and cells, at most.
SAMPLE, FIT_ROUNDS, MOST_CELLS = 20_000, 12, 4096
#: Parts of a residual, and entries of each part's codebook.
PARTS, ENTRIES = 16, 16
#: Cells that a vector lies in, and how many cells there are, in roots of the number of rows.
COPIES, CELLS = 3, 4
#: The share of the cells that a query looks into, and the length of the list that is scored exactly, in results.
SHARE, SHORT_LIST = 0.2, 20
#: Rows of a tile and queries of a block on average, and rows or queries that are compared at once.
TILE, BLOCK, AT_ONCE = 16_384, 8192, 128


@dataclass(frozen=True)
class Model:
    """Cell centres, and codebooks by part and entry, each of a part's length."""

    cells: np.ndarray
    books: np.ndarray

    def to_frame(self, spark) -> DataFrame:
        """The model as rows (book, entry, vector); cells are book -1."""
        rows = [(-1, i, c.tolist()) for i, c in enumerate(self.cells)] + [(p, e, x.tolist()) for p, book in enumerate(self.books) for e, x in enumerate(book)]
        return spark.createDataFrame(rows, "book int, entry int, vector array<double>")

    @staticmethod
    def of_frame(rows: DataFrame) -> Model:
        """The model back from its rows; their number is bounded by MOST_CELLS and the codebooks."""
        found: dict[int, list] = {}
        for r in rows.orderBy("book", "entry").collect():
            found.setdefault(r.book, []).append(r.vector)
        return Model(np.array(found.pop(-1, [])), np.array([found[p] for p in sorted(found)]))


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is there and finite."""
    e = F.col("embedding")
    return rows.where(e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (centres**2).sum(1)
    return np.concatenate([np.zeros(0, int), *((-2 * x[i : i + AT_ONCE] @ centres.T + squares).argmin(1) for i in range(0, len(x), AT_ONCE))])


def _fit(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of k groups of rows, or of fewer if there are fewer distinct rows; groups that lose all rows take the farthest ones."""
    x = np.unique(x, axis=0) if len(x) <= k * 4 else x
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(FIT_ROUNDS):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        lost = np.nonzero(counts == 0)[0]
        centres[lost] = x[((x - centres[own]) ** 2).sum(1).argsort()[::-1][: len(lost)]]
    return centres


def fit(rows: DataFrame, cells: int | None = None) -> Model:
    """A model fitted to the rows with the least hashes of their ids; CELLS times the root of the rows' number of cells."""
    able = usable(rows)
    sample = able.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE).collect()
    if not sample:
        return Model(np.zeros((0, 0)), np.zeros((0, 0, 0)))
    dim = len(sample[0].embedding)
    x = np.array([r.embedding for r in sample if len(r.embedding) == dim], float)
    rng = np.random.default_rng(7)
    centres = _fit(x, cells or max(1, min(MOST_CELLS, len(x) // 2, round(CELLS * able.count() ** 0.5))), rng)
    rest = x - centres[_nearest(x, centres)]
    parts = [_fit(p, ENTRIES, rng) for p in np.array_split(rest, min(PARTS, dim), axis=1)]
    width = max(p.shape[1] for p in parts)
    # Parts of unequal lengths and short codebooks are filled up, so that all have one shape.
    full = [np.pad(np.concatenate([p, np.repeat(p[:1], ENTRIES - len(p), 0)]), ((0, 0), (0, width - p.shape[1]))) for p in parts]
    return Model(centres, np.stack(full))


def _parts(x: np.ndarray, model: Model) -> list[np.ndarray]:
    count, _, width = model.books.shape
    return [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in np.array_split(x, count, axis=1)]


def place(rows: DataFrame, model: Model) -> DataFrame:
    """(row, vec_id, embedding, code, cell) of every usable row of the model's length, in each of its cells; row numbers it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_CELLS

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            x = np.stack(batch["embedding"].to_numpy()).astype(float) if len(batch) else np.zeros((0, m.cells.shape[1]))
            squares = (m.cells**2).sum(1)
            near = np.concatenate([np.zeros((0, min(COPIES, len(squares))), int), *((-2 * x[i : i + AT_ONCE] @ m.cells.T + squares).argsort(1, kind="stable")[:, :COPIES] for i in range(0, len(x), AT_ONCE))])
            for cell in near.T:
                codes = np.stack([_nearest(p, book) for p, book in zip(_parts(x - m.cells[cell], m), m.books, strict=True)], 1).astype(np.int8)
                yield batch.assign(code=list(codes), cell=cell.astype(np.int32))

    able = usable(rows).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    if not len(model.cells):
        return able.where("false").select("*", F.array().cast("array<byte>").alias("code"), F.lit(0).alias("cell"))
    placed = able.where(F.size("embedding") == model.cells.shape[1]).mapInPandas(code, "row long, vec_id long, embedding array<double>, code array<byte>, cell int")
    return placed.repartitionByRange("cell", "row")


def _looking(queries: DataFrame, model: Model, count: int, form: Callable, schema: str) -> DataFrame:
    """What form(query_id, q, cells) makes of each usable query and its nearest cells."""
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            for query_id, q in zip(batch["query_id"], batch["q"], strict=True):
                q = np.asarray(q, float)
                yield form(query_id, q, ((m.cells - q) ** 2).sum(1).argsort(kind="stable")[:count].astype(np.int32))

    able = usable(queries).select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    dim = model.cells.shape[1] if len(model.cells) else -1
    return able.where(F.size("q") == dim).mapInPandas(look, schema)


def probes(queries: DataFrame, model: Model, count: int) -> DataFrame:
    """(query_id, q, cell): the nearest cells of each query."""
    return _looking(queries, model, count, lambda query_id, q, near: pd.DataFrame({"query_id": query_id, "q": [q] * len(near), "cell": near}), "query_id long, q array<double>, cell int")


def _dealt(indexed: DataFrame) -> dict[int, tuple[int, int]]:
    """The first tile of each cell and how many it takes: small cells share a tile, large ones take several; MOST_CELLS bounds it."""
    dealt, tile, held = {}, 0, 0
    for cell, n in sorted((r["cell"], r["count"]) for r in indexed.groupBy("cell").count().collect()):
        if held and held + n > TILE:
            tile, held = tile + 1, 0
        parts = -(-n // TILE)
        dealt[cell] = (tile, parts)
        tile, held = (tile + parts, 0) if parts > 1 else (tile, held + n)
    return dealt


def _by_tile(dealt: dict[int, tuple[int, int]]) -> Callable:
    def form(query_id: int, q: np.ndarray, near: np.ndarray) -> pd.DataFrame:
        met: dict[int, list[int]] = {}
        for cell in near.tolist():
            first, parts = dealt.get(cell, (0, 0))
            for tile in range(first, first + parts):
                met.setdefault(tile, []).append(cell)
        return pd.DataFrame({"query_id": query_id, "q": [q] * len(met), "tile": list(met), "cells": list(met.values())})

    return form


def _best(k: int, shared: Broadcast) -> Callable:
    length = k * SHORT_LIST * COPIES

    def best(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        m, out = shared.value, [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(held) and len(asked):
            x, codes, cell = np.stack(held["embedding"].to_numpy()), np.stack(held["code"].to_numpy()), held["cell"].to_numpy()
            row, ids = held["row"].to_numpy(), held["vec_id"].to_numpy()
            rest = [book[code][:, : len(own)] for book, code, own in zip(m.books, codes.T, np.array_split(np.arange(x.shape[1]), len(m.books)), strict=True)]
            near = (m.cells[cell] + np.concatenate(rest, axis=1)).T
            cells, at = np.unique(cell, return_inverse=True)
            for low in range(0, len(asked), AT_ONCE):
                now = asked.iloc[low : low + AT_ONCE]
                q = np.stack(now["q"].to_numpy())
                looked = np.stack([np.isin(cells, own) for own in now["cells"]])
                for query_id, one, score, seen in zip(now["query_id"], q, q @ near, looked[:, at], strict=True):
                    short = np.nonzero(seen)[0]
                    if len(short) > length:
                        short = short[np.argpartition(-score[short], length)[:length]]
                    short = short[np.unique(row[short], return_index=True)[1]]
                    exact = np.round(x[short] @ one, 6)
                    first = np.lexsort((ids[short], -exact))[:k]
                    out.append((np.full(len(first), query_id), row[short][first], ids[short][first], exact[first]))
        return pd.DataFrame(dict(zip(("query_id", "row", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return best


def search(indexed: DataFrame, queries: DataFrame, k: int, model: Model, share: float = SHARE) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best by inner product among short lists from at most a share of the cells.

    A tile's short list is as long as one of all cells would be, and the tile hands on k rows of it for a query.
    """
    spark, dealt = queries.sparkSession, _dealt(indexed)
    blocks = max(1, -(-queries.count() // BLOCK))
    tiles = spark.createDataFrame([(cell, first, parts) for cell, (first, parts) in dealt.items()], "cell int, first long, parts long")
    held = indexed.join(F.broadcast(tiles), "cell").select((F.col("first") + F.pmod("row", "parts")).alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "row", "vec_id", "cell", "code", "embedding")
    asked = _looking(queries, model, max(1, int(len(model.cells) * share)), _by_tile(dealt), "query_id long, q array<double>, tile long, cells array<int>").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    pairs = held.groupBy("tile", "block").cogroup(asked.groupBy("tile", "block"))
    found = pairs.applyInPandas(_best(k, spark.sparkContext.broadcast(model)), "query_id long, row long, vec_id long, score double")
    # A row of several cells may come from several tiles.
    return top(found.groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score")).drop("row"), k, "vec_id")
