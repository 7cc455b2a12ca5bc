"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's set holds the hashes of its five-word shingles; the k least are its sketch. Documents of equal
sets form a class, and classes are compared once. The retained values of the sketches are the keys of inverted
lists. If two sets are similar enough, their sketches share so many values that they also share one of the
rarest few of each; only those are listed, the rarest first by the number of sketches that hold them.

Short lists give pairs of classes; the bottom-k of the united sketches estimates their similarity, and what
may reach the threshold is verified on the full sets. Long lists are never turned into pairs: their members are
compared with a few central ones, and what that leaves outside a list's largest component is dealt to tiles of bounded
size, with that component and with each other. A pair of tiles counts all overlaps of the full sets at once and hands
on one representative for each linked member. Connected components follow.

Exactness: links are confirmed on full sets of 64-bit hashes. Sets of at most MOST_EXACT shingles lose no link;
for larger ones the listing and the estimate leave MARGIN standard deviations, so that of 100 million pairs just at the
threshold about two are missed (the binomial tail of K draws), and of closer pairs fewer.

Words are lower-cased for A-Z and end at ASCII white space. Texts of fewer words than five have their whole
sequence as one shingle; null texts and texts without words have none and link with nothing. Rows of a null
doc_id are kept by themselves. Repeated rows share one result; rows of one doc_id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.llm.common import bound_batches, components, least_reached, may_hold, removed, tiled, written

#: Words of a shingle, and the least similarity of a link in hundredths.
WORDS, PERCENT = 5, 85
#: Values of a sketch, and the standard deviations left for chance.
K, MARGIN = 96, 6.0
#: Sets up to this size have a partner whose sketch is whole too.
MOST_EXACT = K * PERCENT // 100
#: Members of a list that gives pairs; members and hashes of a tile on average; shared values multiplied at once.
SHORT, TILE, TILE_HASHES, COLUMNS = 48, 192, 400_000, 8192
#: Members of a long list that all its members are compared with first.
HUBS = 8
#: Words remembered in a task.
REMEMBERED = 100_000


class Shingler:
    """Sets of shingle hashes of texts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of a text's shingles."""
        words = (text or "").encode().lower().split()
        if len(words) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64).view(np.int64)
        h = np.array(list(map(self._hash, words)), np.uint64)
        n = len(h) - WORDS + 1
        s = h[:n].copy()
        for j in range(1, WORDS):  # a polynomial of word hashes, then a mix of its bits
            s *= np.uint64(0x9E3779B97F4A7C15)
            s += h[j : j + n]
        s ^= s >> np.uint64(31)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(29)
        return np.unique(s.view(np.int64))


def profiles(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n (size of its set), key (a digest of its set, null if empty) and sketch of each document."""

    @F.pandas_udf("n long, key string, sketch array<long>")
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(x) for x in batch]
            yield pd.DataFrame({"n": [len(s) for s in sets], "key": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], "sketch": [s[:k] for s in sets]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), profile("text").alias("p")).select("doc_id", "p.*")


def full_sets(docs: DataFrame) -> DataFrame:
    """rep (the doc_id) and the full set of each document."""

    @F.pandas_udf("array<long>")
    def full(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler()
        for batch in batches:
            yield pd.Series([shingler.shingles(x) for x in batch], dtype=object)

    return docs.select(F.col("doc_id").cast("long").alias("rep"), full("text").alias("members"))


def inverted_lists(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(value, rep, n): the lists, without values that only one sketch retains."""
    each = reps.select("rep", "n", F.explode("sketch").alias("value"))
    shared = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    grouped = each.join(shared, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    size = F.least("n", F.lit(K))
    share = percent / 100
    whole = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    part = size - F.greatest(F.lit(0), F.floor(size * share - MARGIN * F.sqrt(size * share * (1 - share)))) + 1
    # Values that no other sketch retains come first in the order and take up places in the listing.
    take = F.when(F.col("n") * 100 <= K * percent, whole).otherwise(part) - (size - F.size("common"))
    rows = grouped.withColumn("take", take.cast("int")).where("take > 0")
    return rows.select("rep", "n", F.explode(F.slice("common", F.lit(1), F.col("take"))).alias("c")).select("c.value", "rep", "n")


def _estimate(a: str, b: str, percent: int):
    """Whether the united sketch leaves it possible that two sets reach the threshold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    both = F.size(F.array_intersect(F.array_intersect(union, F.col(a)), F.col(b)))
    k = F.size(union)
    share = percent / 100
    exact = (F.size(a) < K) & (F.size(b) < K) & (F.size(F.array_union(a, b)) <= K)
    return F.when(exact, both * 100 >= k * percent).otherwise(both >= share * k - MARGIN * F.sqrt(k * share * (1 - share)))


def short_pairs(lists: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes from short lists that may reach the threshold."""
    a, b = (lists.select("value", F.col("rep").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    pairs = a.join(b, "value").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    for x in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}")), x)
    return pairs.where(_estimate("s_a", "s_b", percent)).select("a", "b")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b."""
    flat = np.concatenate([*a, *b])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[at] > 1
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])[keep]
    _, column = np.unique(at[keep], return_inverse=True)
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        on = (column >= low) & (column < low + COLUMNS)
        part = np.zeros((len(a) + len(b), min(COLUMNS, int(column.max()) + 1 - low)), np.float32)
        part[owner[on], column[on] - low] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return np.rint(out).astype(np.int64)


def _similar(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets of a and b that are similar enough."""
    both = overlaps(a, b)
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])
    return np.nonzero(100 * both >= percent * (sizes - both))


def hubs(long: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the HUBS most central representatives of each long list with its others of like size.

    Those that are in the most and longest lists are the least edited copies. Lists of the same documents have the same
    ones, and so give few pairs.
    """
    central = long.groupBy("rep", "n").agg(F.sum("m").alias("central"))
    best = W.partitionBy("value").orderBy(F.desc("central"), "rep")
    chosen = long.join(central, ["rep", "n"]).withColumn("place", F.row_number().over(best)).where(F.col("place") <= HUBS)
    of = chosen.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("hubs"))
    # A representative gathers the hubs of all its lists before it meets them, so each of its pairs is made once.
    met = long.join(of, "value").groupBy("rep", "n").agg(F.array_distinct(F.flatten(F.collect_set("hubs"))).alias("hubs"))
    near = F.filter("hubs", lambda h: (F.col("n") * 100 >= h["n"] * percent) & (h["n"] * 100 >= F.col("n") * percent) & (F.col("rep") != h["rep"]))
    pairs = met.select("rep", F.explode(near).alias("h"))
    return pairs.select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b")).distinct()


def tile_pairs(tiles: DataFrame) -> DataFrame:
    """(value, i, j): the pairs of a list's tiles that have to be compared; i is one of strays, j no later one or one of the rest."""
    return tiles.where("tile >= 0").select("value", F.col("tile").alias("i"), F.explode(F.sequence(-F.col("many"), F.col("tile"))).alias("j"))


def compare_tiles(lists: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(rep, root): links between components within long lists, one for each linked member of a pair of tiles.

    lists has value, rep, its set's size n and its component c so far. Only members outside a list's largest component
    are compared with it and with each other.
    """
    placed = tiled(lists.withColumnRenamed("rep", "key"), ["value"], TILE, "n", TILE_HASHES).withColumnRenamed("key", "rep")
    tiles, _ = written(placed.join(sets, "rep").groupBy("value", "tile", "many").agg(F.collect_list(F.struct("rep", "c", "members")).alias("rows")))
    blobs = [tiles.select("value", F.col("tile").alias(x), *(F.col(f"rows.{c}").alias(f"{c}_{x}") for c in ("rep", "c", "members"))) for x in "ij"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                u, v = _similar(list(row.members_i), list(row.members_j), percent)
                apart = row.c_i[u] != row.c_j[v]
                ids, at = np.unique(np.concatenate([row.rep_i[u[apart]], row.rep_j[v[apart]]]), return_inverse=True)
                if len(ids):
                    roots = ids[least_reached(len(ids), at[: apart.sum()], at[apart.sum() :])]
                    yield pd.DataFrame({"rep": ids[ids != roots], "root": roots[ids != roots]})

    return tile_pairs(tiles).join(blobs[0], ["value", "i"]).join(blobs[1], ["value", "j"]).mapInPandas(each, "rep long, root long")


def needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of these ids; a filter of fixed size keeps most others out of the shuffle."""
    keys = ids.select(F.xxhash64("rep").alias("place"))
    some = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("place")).where("doc_id is not null")
    return may_hold(some, keys, "place").drop("place").join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")


def links(docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): confirmed links between classes, enough of them to connect what is linked."""
    index, path = written(inverted_lists(reps, percent))
    sizes = index.groupBy("value").agg(F.count("*").alias("m")).where("m > 1")
    index = index.join(sizes, "value")
    long, long_path = written(index.where(F.col("m") > SHORT).select("value", "rep", "n", "m"))
    # The members of a long list are compared with a few of them first, which connects near copies of one text.
    pairs, pairs_path = written(short_pairs(index.where(F.col("m") <= SHORT), reps, percent).union(hubs(long, percent)).distinct())
    removed(docs.sparkSession, path)
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(long.select("rep")).distinct()
    sets, sets_path = written(full_sets(needed(docs, ids)).dropDuplicates())
    confirmed = pairs
    for x in "ab":
        confirmed = confirmed.join(sets.select(F.col("rep").alias(x), F.col("members").alias(f"m_{x}")), x)
    both = F.size(F.array_intersect("m_a", "m_b"))
    confirmed = confirmed.where(both * 100 >= (F.size("m_a") + F.size("m_b") - both) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found, _ = written(confirmed)
    rest = long.select("value", "rep", "n").join(components(found).toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    across, _ = written(compare_tiles(rest, sets, percent).toDF("u", "v"))
    for done in (long_path, pairs_path, sets_path):
        removed(docs.sparkSession, done)
    return found.union(across)


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    bound_batches(docs.sparkSession)
    profile, _ = written(profiles(docs))
    classes = profile.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    first = profile.select("doc_id", "key", "n", "sketch").join(classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi")
    reps, _ = written(first.dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("rep"), "n", "sketch"))
    reached = components(links(docs, reps, percent)).toDF("rep", "component")
    of_class, _ = written(classes.join(reached, "rep", "left").select("key", F.coalesce("component", "rep").alias("component")))
    out = profile.select("doc_id", "n", "key").join(of_class, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
