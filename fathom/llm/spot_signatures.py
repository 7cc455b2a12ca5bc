"""Document fingerprints by SpotSigs, in DataFrame expressions throughout.

Each occurrence of an anchor, a common word, gives a signature: the anchor and the chain of the CHAIN content words
that follow it, where common words are passed over. A document's fingerprint names its set of signatures, so equal
texts have equal fingerprints, and edited ones share the signatures that the edit leaves whole. A text whose anchors
have no chain has its whole sequence of words as one signature; a text without words has none.

Near duplicates: documents of one fingerprint form a class. Classes are partitioned by the size of their sets, so
that sets whose sizes alone rule a link out never meet; within a partition an inverted index lists each set under its
rarest signatures only, as many as a similar set must share one of. Candidates are pruned by their sizes and by the
places at which they meet, and confirmed by the exact Jaccard similarity of the whole sets. In long lists all members
are compared with one of them, and what that connects is not compared again (common.dealt). Components follow.

Signatures are 64-bit hashes. Words are runs of letters and digits in lower case. Null texts count as empty; two
empty fingerprints have likeness 1, and one with another 0. Rows with the same doc_id and text are one document with
one result for each row; rows of one doc_id with different texts are documents of their own, in the order of a hash.
A null doc_id comes last in the order, and its rows are kept by themselves. A single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.functions.text import let, tokens
from fathom.llm.common import components, dealt, let_go, may_hold, removed, written

#: Common words of English, German, French and Spanish: fixed values. Those that start chains, and the others.
ANCHORS = ("the", "is", "that", "was", "to", "and", "der", "die", "das", "und", "ist", "le", "la", "les", "des", "et", "est", "el", "los", "que", "es", "en")
OTHERS = (
    "of", "a", "in", "it", "for", "on", "with", "be", "as", "by", "this", "are", "at", "an", "from", "he", "his", "her", "or", "not", "but", "had", "have", "has",
    "which", "you", "were", "their", "been", "de", "du", "un", "une", "au", "aux", "pour", "dans", "par", "sur", "qui", "ne", "pas", "plus", "ce", "il", "elle",
    "von", "zu", "den", "dem", "mit", "sich", "auf", "für", "nicht", "ein", "eine", "im", "als", "auch", "del", "las", "por", "con", "una", "su", "para", "lo", "se", "al",
)
COMMON = ANCHORS + OTHERS
#: Content words of a chain, and the least similarity of a link in hundredths.
CHAIN, PERCENT = 2, 80
#: Members of a list that gives pairs, and of a tile on average in longer ones.
SHORT, TILE = 48, 256


def signatures(text: Column) -> Column:
    """The sorted distinct signatures of a text, in time linear in its words."""
    none = F.array().cast("array<long>")

    def chains(w: Column) -> Column:
        content = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~F.get(w, i).isin(*COMMON))

        def of(at: Column) -> Column:
            # Common words only stand between two content words, so each is looked at once, before the word that follows.
            before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(at, k - 1))
            first = lambda k: F.slice(w, before(k) + 2, F.get(at, k) - before(k) - 1)
            each = lambda k: F.transform(F.filter(first(k), lambda a: a.isin(*ANCHORS)), lambda a: F.xxhash64(a, *(F.get(w, F.get(at, k + i)) for i in range(CHAIN))))
            places = F.filter(F.sequence(F.lit(0), F.size(at) - CHAIN), lambda k: F.get(at, k) - before(k) > 1)
            return F.when(F.size(at) >= CHAIN, F.flatten(F.transform(places, each))).otherwise(none)

        return let(content, of)

    whole = lambda w: F.array(F.xxhash64(F.array_join(w, " ")))
    some = lambda w: let(chains(w), lambda c: F.when(F.size(c) > 0, F.sort_array(F.array_distinct(c))).otherwise(whole(w)))
    return let(tokens(text), lambda w: F.when(F.size(w) > 0, some(w)).otherwise(none))


def fingerprint(sigs: Column) -> Column:
    """The name of a set of signatures."""
    return F.md5(F.array_join(F.transform(sigs, lambda s: s.cast("string")), ","))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two sets of signatures; 1 if both are empty."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both)))


def _named(docs: DataFrame) -> DataFrame:
    """name, doc_id and text of each row; a name stands for a doc_id and a text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.select(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text")).alias("name"), "doc_id", "text")


def profiles(docs: DataFrame) -> DataFrame:
    """id, name, doc_id, n_chars, fingerprint and sigs of each row, as a table; ids are the rows' own."""
    both = let(signatures(F.col("text")), lambda s: F.struct(fingerprint(s).alias("fingerprint"), s.alias("sigs")))
    return _named(docs).select(F.monotonically_increasing_id().alias("id"), "name", "doc_id", F.length("text").cast("long").alias("n_chars"), both.alias("p")).select("id", "name", "doc_id", "n_chars", "p.*")


def index(reps: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, str]:
    """(cell, sig, id, n, left, own), a table and its path: sets under their rarest signatures, by partitions of their sizes.

    A set is in the cell of its own size and, not as its own, in the one below; left counts the signatures of the set
    from there on, in the order of rarity.
    """
    each = reps.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    shared, path = written(each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1"))
    common = may_hold(each, shared, "sig").join(shared, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("common"))
    # Signatures that no other set has come first in the order and take up places.
    alone = F.col("n") - F.size("common")
    take = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    listed = common.withColumns({"alone": alone, "take": take}).where("take > 0").select("id", "n", "alone", F.posexplode(F.slice("common", F.lit(1), F.col("take"))).alias("at", "c"))
    cell = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    placed = listed.select("c.sig", "id", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), cell.alias("of"))
    rows, rows_path = written(placed.select("sig", "id", "n", "left", "of", F.explode(F.array("of", F.col("of") - 1)).alias("cell")).select("cell", "sig", "id", "n", "left", (F.col("cell") == F.col("of")).alias("own")))
    removed(reps.sparkSession, path)
    return rows, rows_path


def _enough(both: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether so many common members make sets of n and m similar enough."""
    return both * (100 + percent) >= (n + m) * percent


def confirmed(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (u, v) those whose whole sets are similar enough."""
    for x in "uv":
        pairs = pairs.join(reps.select(F.col("id").alias(x), F.col("sigs").alias(f"sigs_{x}")), x)
    return pairs.where(_enough(F.size(F.array_intersect("sigs_u", "sigs_v")), F.size("sigs_u"), F.size("sigs_v"), percent)).select("u", "v")


def links(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): confirmed links between sets, enough of them to connect all that are linked."""
    rows, rows_path = index(reps, percent)
    sizes = rows.groupBy("cell", "sig").agg(F.count("*").alias("m"), F.count_if("own").alias("owns")).where("m > 1 and owns > 0").drop("owns")
    listed, path = written(rows.join(sizes, ["cell", "sig"]))
    removed(reps.sparkSession, rows_path)
    short, long = listed.where(F.col("m") <= SHORT), listed.where(F.col("m") > SHORT)
    near = (F.col("n_u") * 100 >= F.col("n_v") * percent) & (F.col("n_v") * 100 >= F.col("n_u") * percent)
    # Where two sets first meet in the order of rarity, what is left of each bounds what they have in common.
    may = near & (F.col("own_u") | F.col("own_v")) & _enough(F.least("left_u", "left_v"), F.col("n_u"), F.col("n_v"), percent)
    a, b = (short.select("cell", "sig", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "left", "own"))) for x in "uv")
    pairs = a.join(b, ["cell", "sig"]).where((F.col("id_u") < F.col("id_v")) & may).select(F.col("id_u").alias("u"), F.col("id_v").alias("v"))
    hubs, hubs_path = written(long.groupBy("cell", "sig").agg(F.min(F.struct("id", "n")).alias("hub")).select("cell", "sig", F.col("hub.id").alias("u"), F.col("hub.n").alias("n_u")))
    star = long.select("cell", "sig", F.col("id").alias("v"), F.col("n").alias("n_v")).join(hubs, ["cell", "sig"]).where((F.col("u") != F.col("v")) & near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    found, _ = written(confirmed(pairs.union(star).distinct(), reps, percent))
    removed(reps.sparkSession, hubs_path)
    members = long.select("cell", "sig", F.col("id").alias("key"), "n", "left", "own").join(components(found).toDF("key", "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
    groups = dealt(members, ["cell", "sig"], TILE).join(reps.select(F.col("id").alias("key"), "sigs"), "key")
    of = ["cell", "sig", "i", "j"]
    a, b = (groups.select(*of, *(F.col(c).alias(f"{c}_{x}") for c in ("key", "c", "tile", "n", "left", "own", "sigs"))) for x in "uv")
    once = (F.col("key_u") < F.col("key_v")) & ((F.col("i") == F.col("j")) | (F.col("tile_u") != F.col("tile_v"))) & (F.col("c_u") != F.col("c_v"))
    exact = _enough(F.size(F.array_intersect("sigs_u", "sigs_v")), F.col("n_u"), F.col("n_v"), percent)
    # The exact test is part of the join, so pairs that are not links never become rows.
    across, _ = written(a.join(b, of).where(once & may & exact).select(F.col("key_u").alias("u"), F.col("key_v").alias("v")))
    removed(reps.sparkSession, path)
    return found.union(across)


def near_duplicates(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(fingerprint, component_id): of each class that has a doc_id and signatures, the least doc_id that it reaches."""
    classes, _ = written(found.where("size(sigs) > 0 and doc_id is not null").groupBy("fingerprint").agg(F.min("id").alias("id"), F.min("doc_id").alias("least")))
    reps, path = written(found.select("id", "sigs").join(classes.select("id"), "id", "left_semi"))
    reached = components(links(reps, percent)).toDF("id", "c")
    removed(found.sparkSession, path)
    of, _ = written(classes.join(reached, "id", "left").select("fingerprint", "least", F.coalesce("c", "id").alias("c")))
    return written(of.join(of.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fingerprint", "component_id"))[0]


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, fingerprint, n_signatures, component_id and kept of every document."""
    found, _ = written(profiles(docs))
    return _with_components(found.select("doc_id", "fingerprint", F.size("sigs").cast("long").alias("n_signatures")), near_duplicates(found, percent))


def _with_components(rows: DataFrame, of: DataFrame) -> DataFrame:
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    joined = rows.join(of, "fingerprint", "left").withColumn("component_id", component)
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def successors(found: DataFrame) -> DataFrame:
    """(name, doc_id, n_chars, next): each document and the name of the next one, by doc_id; after the last comes the first.

    Documents are laid out in ranges of ids, and neighbours found within a range; only the first document of each
    range, as many rows as there are ranges, meets the others.
    """
    by = [F.col("doc_id").asc_nulls_last(), F.col("name")]
    once = found.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"))
    laid, _ = written(once.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    firsts = laid.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name")).alias("f")).select("range", F.col("f.name").alias("name"))
    w = W.orderBy("range")
    after = firsts.select("range", F.coalesce(F.lead("name").over(w), F.first("name").over(w)).alias("beyond"))
    return laid.withColumn("next", F.lead("name").over(W.partitionBy("range").orderBy(*by))).join(after, "range").select("name", "doc_id", "n_chars", F.coalesce("next", "beyond").alias("next"))


def digests(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each document's fingerprint, that of its edited text, the likeness of both and to the next document's, and its component.

    The edited text has the last quarter of the characters replaced by as many of the next document's first ones.
    """
    spark = docs.sparkSession
    found, path = written(profiles(docs))
    of = near_duplicates(found, percent)
    let_go(spark)
    asked, asked_path = written(successors(found))
    removed(spark, path)
    let_go(spark)
    # Signatures are made again from the texts, which travel anyway, rather than sent beside them; both uses of the
    # texts have the same columns, so they are shuffled once.
    texts = _named(docs).select("name", "text")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = asked.select(F.col("next").alias("name"), F.col("name").alias("asker"), "doc_id", "n_chars", quarter.alias("quarter"))
    heads = texts.join(wanted, "name").select("asker", "doc_id", "n_chars", "quarter", F.left("text", F.col("quarter")).alias("head"), signatures(F.col("text")).alias("next_sigs")).dropDuplicates(["asker"])
    rows = texts.join(heads.withColumnRenamed("asker", "name"), "name")
    edited = rows.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - F.col("quarter")).cast("int")), F.col("head")))

    def compared(s: Column) -> Column:
        first, second = s["text"], s["edited"]
        return F.struct(
            fingerprint(first).alias("fingerprint"), fingerprint(second).alias("edited_fingerprint"), likeness(first, second).alias("near_edited"),
            likeness(first, F.col("next_sigs")).alias("near_next"), F.size(first).cast("long").alias("n_signatures"),
        )

    both = F.struct(signatures(F.col("text")).alias("text"), signatures(F.col("edited")).alias("edited"))
    out = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), let(both, compared).alias("e"))
    out, _ = written(out.select("doc_id", "n_chars", "edited_sha256", "e.*"))
    removed(spark, asked_path)
    return _with_components(out, of).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "component_id", "kept")
