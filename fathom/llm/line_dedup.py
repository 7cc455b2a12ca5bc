"""Fuzzy line dedup by MinHash, in DataFrame expressions throughout.

A line is lower-cased and trimmed; its shingles are the runs of SHINGLE characters at every position, a shorter
line being one shingle. Each distinct line's shingles become rows, hashed in generated code. The signature has 64
slots: four orders of the hashes with 16 bins each, a slot being the least hash of its bin. A line of many shingles
only keeps hashes below a limit that leaves about KEPT of them for each bin, so that the minima of nearly all bins
are found among few rows; a bin that keeps none is empty, and empty slots are equal. Repetitive lines, which have few
distinct shingles, also get bands of all their hashes. Slots of two lines are so equal
with at least the probability of their similarity (less where their limits differ; tests measure the recall by
length). Sixteen bands of four slots share no slot; a band without any hash puts its line in no bucket.

Lines of a bucket are compared with its most frequent line, and those that are then outside the bucket's largest
component with that component and each other, in tiles of bounded size; a pair counts only if the exact Jaccard similarity of the full shingle sets is at
least PERCENT. Components keep their first line, by doc_id, then position.

Lines that are equal after normalisation are one line. Blank lines always stay. Null texts stay null. A null
doc_id comes last in the order. Repeated rows of a document keep the same lines. Whole lines of any length count.
Lines are named by a 64-bit hash of their normal form. Columns of the input may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import let
from fathom.llm.common import components, dealt, let_go, may_be_among, may_hold, removed, written

#: Characters of a shingle.
SHINGLE = 10
#: Least Jaccard similarity, in hundredths.
PERCENT = 80
#: Orders of the hashes, bins and so slots of each, and slots of a band; every slot is in one band.
ORDERS, BINS, BAND = 4, 16, 4
BANDS = ORDERS * BINS // BAND
#: Hashes of a line that a bin keeps on average, if there are so many.
KEPT = 2
#: Whatever its length, a line keeps this share of its hashes; and shingles looked at to see whether it repeats itself.
LEAST_SHARE, PROBES = 1 / 16, 8
#: Bits of a hash in an order, and of its place within a bin; two orders share a 64-bit hash.
BITS, PLACE = 32, 28
#: The limit of a repetitive line's second set of bands, which keeps all hashes.
ALL = (1 << PLACE) + 1
#: Of the 64 bits of two lines' sketches so many may differ: lines of similarity 0.8 differ in about 6, with a standard
#: deviation of 2.4.
MOST_APART = 16
#: Lines of a tile on average, when the lines of a bucket are compared with each other.
TILE = 256
LAST = (1 << 63) - 1
SPACE = " \t\x0b\f\r"


def _hashes(norm: Column) -> Column:
    """Hashes of a text's runs of SHINGLE characters, one for each position; a shorter text is one run."""
    # Four bytes a character, so that a position is found without a walk through the text.
    each = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(t) / 4).cast("int") - SHINGLE, F.lit(0))), lambda i: F.xxhash64(F.substring(t, i * 4 + 1, F.lit(4 * SHINGLE))))
    return let(F.encode(norm, "UTF-32"), each)


def shingles(norm: str) -> Column:
    """Distinct hashes of a line's shingles."""
    return F.array_distinct(_hashes(F.col(norm)))


def _least(hashed: DataFrame, by: list[str]) -> DataFrame:
    """(by, band, least_0 ...): the slots of each band of a line, from rows of its hashes h and its limit; by names a line."""
    mask, low = F.lit((1 << BITS) - 1), F.lit((1 << PLACE) - 1)
    more = F.xxhash64("h")
    orders = [part.bitwiseOR(F.lit(i << BITS)) for i, part in enumerate(x for h in (F.col("h"), more) for x in (h.bitwiseAND(mask), F.shiftrightunsigned(h, BITS)))]
    kept = lambda v: v.bitwiseAND(low) < F.col("limit")
    some = hashed.where(reduce(lambda x, y: x | y, map(kept, orders)))
    each = some.select(*by, "limit", F.explode(F.array(*orders)).alias("v")).where(kept(F.col("v")))
    slot = F.shiftrightunsigned("v", PLACE).bitwiseAND(F.lit(BAND - 1))
    # The second set of bands of a line has numbers of its own.
    number = F.shiftrightunsigned("v", PLACE + BAND.bit_length() - 1).cast("int") + F.when(F.col("limit") == ALL, BANDS).otherwise(0)
    placed = each.select(*by, number.alias("band"), slot.alias("slot"), F.col("v").bitwiseAND(low).alias("place"))
    return placed.groupBy(*by, "band").agg(*(F.min(F.when(F.col("slot") == i, F.col("place"))).alias(f"least_{i}") for i in range(BAND)))


def banded(hashed: DataFrame, by: list[str]) -> DataFrame:
    """(by, band): a hash of each of a line's bands."""
    return _least(hashed, by).select(*by, F.xxhash64(F.col("band") % BANDS, *(F.coalesce(f"least_{i}", F.lit(-1).cast("long")) for i in range(BAND))).alias("band"))


def sketches(norms: DataFrame) -> DataFrame:
    """(key, bits): one bit of each slot, so that two lines' bits differ in about half of the slots that differ.

    Repetitive lines have none, as their limits may differ from those of lines like them.
    """
    bits = reduce(lambda x, y: x.bitwiseOR(y), (F.expr(f"shiftleft(coalesce(least_{i}, 0L) & 1L, band * {BAND} + {i})") for i in range(BAND)))
    return _least(_hashed(norms.repartition("key"), ["key"]), ["key"]).groupBy("key").agg(F.bit_or(bits).alias("bits"), F.max("band").alias("last")).where(F.col("last") < BANDS).drop("last")


def _limit(count: Column) -> Column:
    """The place in its bin that a kept hash of a line of so many shingles stays below."""
    return F.least(F.lit(float(1 << PLACE)), F.greatest(F.lit(float(LEAST_SHARE * (1 << PLACE))), F.lit(float(KEPT * BINS << PLACE)) / F.greatest(count, F.lit(1)))).cast("long")


def signed(rows: DataFrame, hashes: str) -> DataFrame:
    """The rows with the column bands, hashes of BAND slots each, in place of their shingles' hashes; rows differ."""
    rest = [c for c in rows.columns if c != hashes]
    each = rows.select(*rest, _limit(F.size(hashes)).alias("limit"), F.explode(hashes).alias("h"))
    return banded(each, rest).groupBy(*rest).agg(F.collect_list("band").alias("bands"))


def _normal(line: str) -> Column:
    x = F.col(line)
    edged = reduce(lambda a, b: a | b, (f(x, F.lit(c)) for c in SPACE for f in (F.startswith, F.endswith)))
    return F.lower(F.when(edged, F.trim(x, F.lit(SPACE))).otherwise(x))


def lines_of(docs: DataFrame) -> DataFrame:
    """(d, t, pos, norm) of every line that is not blank; d and t name a document and its text."""
    each = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return each.select("d", "t", "pos", _normal("line").alias("norm")).where("norm <> ''")


def _limits(wide: Column, size: Column) -> Column:
    """The limits by which a line of so many shingles keeps hashes: one, and for a repetitive line another that keeps all.

    A line counts as repetitive if any of PROBES shingles of it are equal; one of few distinct shingles nearly always
    does, and by keeping all it meets its like whatever their lengths.
    """
    probes = F.array(*(F.xxhash64(F.substring(wide, (size * k / PROBES).cast("int") * 4 + 1, F.lit(4 * SHINGLE))) for k in range(PROBES)))
    repetitive = (size > KEPT * BINS) & (F.size(F.array_distinct(probes)) < PROBES)
    return F.when(repetitive, F.array(_limit(size), F.lit(ALL).cast("long"))).otherwise(F.array(_limit(size)))


def _hashed(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, limit, h): the hashes of the shingles of the lines' normal forms, norm."""
    # Four bytes a character, so that a position is found without a walk through the text.
    wide = lines.select(*by, F.encode("norm", "UTF-32").alias("wide"))
    last = F.greatest(F.shiftright(F.length("wide"), 2) - SHINGLE, F.lit(0))
    limited = wide.select(*by, "wide", F.explode(_limits(F.col("wide"), last + 1)).alias("limit"))
    # The sequence names both columns, so that they are worked out before the loop over it and not within.
    starts = limited.select(*by, "wide", "limit", F.explode(F.when(F.col("limit") > 0, F.sequence(F.lit(0), last))).alias("i"))
    # An array of one, so that the filter on the hash does not make Spark work it out again for each use.
    return starts.select(*by, "limit", F.explode(F.array(F.xxhash64(F.substring("wide", F.col("i") * 4 + 1, F.lit(4 * SHINGLE))))).alias("h"))


def signatures(docs: DataFrame) -> DataFrame:
    """(key, n, band) of each distinct line's bands; n counts the line's rows.

    Equal lines meet in one shuffle, and a line's bands are made where it then is.
    """
    lines = lines_of(docs).select(F.xxhash64("norm").alias("key"), "norm")
    return banded(_hashed(lines.groupBy("key").agg(F.first("norm").alias("norm"), F.count("*").alias("n")), ["key", "n"]), ["key", "n"])


def buckets(bands: DataFrame) -> DataFrame:
    """(band, key, n) of the buckets with more than one line."""
    several, path = written(bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band"))
    members, _ = written(may_hold(bands, several, "band").join(several, "band").select("band", "key", "n"))
    removed(bands.sparkSession, path)
    return members


def _similar(a: Column, b: Column) -> Column:
    """Whether two sets are similar enough, each given by hashes that may repeat."""
    return F.size(F.array_intersect(a, b)) * 100 >= F.size(F.array_union(a, b)) * PERCENT


def _near(a: str, b: str) -> Column:
    """Whether two sketches leave it possible that their lines are similar enough; so does a missing one."""
    return F.coalesce(F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_APART, F.lit(True))


def confirmed(pairs: DataFrame, norms: DataFrame) -> DataFrame:
    """Of pairs (u, v) those whose full shingle sets are similar enough."""
    # Texts go to the pairs, not their sets: a set takes eight bytes for each character.
    for x in "uv":
        pairs = pairs.join(norms.toDF(x, f"norm_{x}"), x)
    both = F.struct(_hashes(F.col("norm_u")).alias("u"), _hashes(F.col("norm_v")).alias("v"))
    return pairs.where(let(both, lambda s: _similar(s["u"], s["v"]))).select("u", "v")


def links(members: DataFrame, norms: DataFrame) -> DataFrame:
    """(u, v): confirmed links, enough of them to connect all lines that any bucket links."""
    bits, _ = written(sketches(norms))
    chosen, _ = written(members.groupBy("band").agg(F.max_by("key", F.struct("n", "key")).alias("u")))
    pairs = members.select("band", F.col("key").alias("v")).join(chosen, "band").where("u <> v").select("u", "v").distinct()
    for x in "uv":
        pairs = pairs.join(bits.toDF(x, f"bits_{x}"), x, "left")
    star, _ = written(confirmed(pairs.where(_near("bits_u", "bits_v")).select("u", "v"), norms))
    # What is left: buckets with lines of several components. Their most frequent line has been compared with all.
    rest = members.join(chosen, "band").where("key <> u").select("band", "key").join(components(star).toDF("key", "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
    groups, _ = written(dealt(rest, ["band"], TILE))
    own = members.join(groups.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("band")).alias("bands"))
    dealt_lines = groups.join(own.join(bits, "key", "left").join(norms, "key"), "key").select("band", "key", "c", "bits", "bands", "tile", "i", "j", "norm")
    # Texts are dealt and become sets where they are compared, so each is hashed once in its group and no set travels.
    dealt_lines = dealt_lines.repartition("band", "i", "j").withColumn("h", shingles("norm"))
    a, b = (dealt_lines.select("band", "i", "j", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "c", "bits", "bands", "tile", "h"))) for x in "uv")
    n, m = F.size("h_u"), F.size("h_v")
    first = a["band"] == F.element_at(F.array_intersect("bands_u", "bands_v"), 1)  # a pair is tested in one of its buckets
    exact = F.size(F.array_intersect("h_u", "h_v")) * (100 + PERCENT) >= (n + m) * PERCENT  # of sets
    once = (F.col("key_u") < F.col("key_v")) & ((a["i"] == a["j"]) | (F.col("tile_u") != F.col("tile_v"))) & (F.col("c_u") != F.col("c_v"))
    near = _near("bits_u", "bits_v") & (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT)
    # The exact test is part of the join, so pairs that are not links never become rows.
    across = a.join(b, (a["band"] == b["band"]) & (a["i"] == b["i"]) & (a["j"] == b["j"]) & once & near & first & exact)
    return star.union(across.select(F.col("key_u").alias("u"), F.col("key_v").alias("v")))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(d, t, gone): the positions of each document's lines that an earlier line of their component stands for."""
    spark = docs.sparkSession
    bands, bands_path = written(signatures(docs))
    let_go(spark)
    members = buckets(bands)
    removed(spark, bands_path)
    keys, _ = written(members.select("key").distinct())
    # One pass over the texts names all lines and keeps the normal forms that are needed.
    each = may_be_among(lines_of(docs).withColumn("key", F.xxhash64("norm")), keys, "key", "may")
    lines, lines_path = written(each.select("d", "t", "pos", "key", F.when(F.col("may"), F.col("norm")).alias("norm")))
    norms, norms_path = written(lines.where("norm is not null").select("key", "norm").join(keys, "key").groupBy("key").agg(F.first("norm").alias("norm")))
    let_go(spark)
    reached, _ = written(components(links(members, norms)).toDF("key", "c"))
    removed(spark, norms_path)
    # Only lines that are repeated or linked can go.
    named = lines.groupBy("key").agg(F.count("*").alias("n")).join(reached, "key", "left").where("n > 1 or c is not null").select("key", F.coalesce("c", "key").alias("c"))
    named, _ = written(named)
    mine = may_hold(lines.select("d", "t", "pos", "key"), named, "key").join(named, "key").select("c", F.struct("d", "t", "pos").alias("at"))
    best, _ = written(mine.groupBy("c").agg(F.min("at").alias("best")))  # written, so that Spark can split the join of a large component
    gone, _ = written(mine.join(best, "c").where("at <> best").groupBy("at.d", "at.t").agg(F.collect_set("at.pos").alias("gone")))
    removed(spark, lines_path)
    let_go(spark)
    return gone


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with removed lines taken from their texts; all other columns stay as they are."""
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("t"))
    joined = keyed.join(removed_lines(docs), ["d", "t"], "left")
    text = F.col("row").getField("text")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.select(*((F.when(F.col("gone").isNull(), text).otherwise(kept) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def _lines(text: str) -> Column:
    """How many lines a text has."""
    return F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, lines before and after, and a digest of the text that is left."""
    before = docs.select("doc_id", "text").withColumn("n_lines", F.coalesce(_lines("text"), F.lit(0)).cast("long"))
    after = dedup(before)
    return after.select("doc_id", "n_lines", F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(_lines("text")).cast("long").alias("n_kept"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
