"""Best-fit packing into sequences of several permitted lengths.

Documents go to shards by a hash of their row's number in a written table, so that equal rows spread too; the number
of shards follows the number of documents, so a shard stays at about SHARD_DOCS of them at any size. A shard's pieces, longest first, each go to the open bin that
they leave the least room in. If none has room, a bin of the size of least cost opens: of the sizes that hold
the piece, the one with the least cost for each token that it can be filled with by the pieces still to come.
At the end each bin shrinks to the smallest permitted length that holds its contents.

Texts are counted in words. A text longer than the longest length is cut into pieces of that length and a
rest. Null and blank texts have no words: they keep a row with n_tokens 0 and no bin. Repeated rows are packed
each; a null doc_id is packed like any other. Ties go by doc_id, then start.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import written

#: Permitted sequence lengths, and what a sequence costs besides its length.
LENGTHS, SEQUENCE_COST = (256, 512, 1024, 2048, 4096), 32
#: Documents of a shard on average.
SHARD_DOCS = 4000
PLACED = "doc_id long, start long, n_tokens long, shard long, bin long, capacity int, position int"


def pack(pieces: list[int], lengths: tuple[int, ...] = LENGTHS, cost: int = SEQUENCE_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and position of each piece, and the final capacity of each bin; pieces come longest first."""
    rest = [0] * (len(pieces) + 1)  # words of the pieces from each place on
    for i in range(len(pieces) - 1, -1, -1):
        rest[i] = rest[i + 1] + pieces[i]
    falling = [-n for n in pieces]
    room: list[tuple[int, int]] = []  # (words left, bin), sorted
    bins, positions, filled = [], [], []
    for i, n in enumerate(pieces):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            best = None
            for size in lengths:
                if size >= n:
                    # What can still come: pieces no longer than the room beside this one.
                    first = max(i + 1, bisect_left(falling, n - size))
                    use = min(size, n + rest[first])
                    if best is None or (cost + size) * best[1] < best[0] * use:
                        best = (cost + size, use, size)
            left, k = best[2], len(filled)
            filled.append(0)
        bins.append(k)
        positions.append(filled[k])
        filled[k] += n
        if left > n:
            insort(room, (left - n, k))
    return bins, positions, [next(size for size in lengths if size >= n) for n in filled]


def _shard(lengths: tuple[int, ...], cost: int):
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, positions, capacities = pack(rows["n_tokens"].tolist(), lengths, cost)
        return rows.assign(bin=bins, position=positions, capacity=[capacities[k] for k in bins])[[x.split()[0] for x in PLACED.split(", ")]].astype({"doc_id": "Int64"})

    return packed


def best_fit(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, cost: int = SEQUENCE_COST) -> DataFrame:
    """(doc_id, start, n_tokens, shard, bin, capacity, position): where each piece of each document goes.

    start is the piece's first word in its document, position its first word in the bin; shard and bin name a
    sequence together.
    """
    longest = max(lengths)
    words = F.when(F.trim(F.regexp_replace("text", r"\s", " ")) == "", 0).otherwise(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))))
    counted, _ = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(words, F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64(F.monotonically_increasing_id()).alias("spread")))
    shards = max(1, -(-counted.count() // SHARD_DOCS))
    cut = F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(longest).cast("long")))
    pieces = counted.where("n_tokens > 0").select("doc_id", F.explode(cut).alias("start"), "n_tokens", F.pmod("spread", F.lit(shards)).alias("shard"))
    pieces = pieces.withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("start"), F.lit(longest)))
    placed = pieces.groupBy("shard").applyInPandas(_shard(tuple(sorted(lengths)), cost), PLACED)
    empty = counted.where("n_tokens = 0").selectExpr("doc_id", "0L as start", "n_tokens", "null as shard", "null as bin", "null as capacity", "null as position")
    return placed.unionByName(empty)


def with_texts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The sequences themselves: (shard, bin, capacity, n_tokens, doc_ids, text), pieces in order."""
    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("words"))
    pieces = placed.where("bin is not null").join(words, placed["doc_id"].eqNullSafe(words["doc_id"])).select("shard", "bin", "capacity", "position", "n_tokens", placed["doc_id"], F.concat_ws(" ", F.slice("words", F.col("start").cast("int") + 1, F.col("n_tokens").cast("int"))).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "doc_id", "text")))
    return pieces.groupBy("shard", "bin", "capacity").agg(F.sum("n_tokens").alias("n_tokens"), ordered.alias("p")).select("shard", "bin", "capacity", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.concat_ws(" ", "p.text").alias("text"))
