"""Sentences and windows of them, with abbreviations learned from the corpus.

A word that ends with a full stop, an exclamation or a question mark ends a sentence unless the next word begins with
a lower-case letter or the word is an abbreviation. Abbreviations are told by statistics over all texts: words of at
most SHORT letters that mostly stand with a full stop, and whose full stop is often followed by a lower-case word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import let

#: Letters of an abbreviation at most; of its occurrences this share has a full stop, and of those this share goes on in lower case, in hundredths.
SHORT, DOTTED, GOES_ON = 5, 80, 20
END = r"""[.!?]["')\]]*$"""


def words(text: Column) -> Column:
    """The words of a text between white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")


def abbreviations(docs: DataFrame) -> DataFrame:
    """(name) of each abbreviation, in lower case without its full stop; only counts of words are shuffled."""
    after = lambda ws, i: F.coalesce(F.get(ws, i + 1), F.lit(""))
    pairs = let(words(F.col("text")), lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), after(ws, i).rlike(r"^\p{Ll}").alias("low"))))
    each = docs.where("text is not null").select(F.inline(pairs)).where(F.col("w").rlike(rf"^\p{{L}}{{1,{SHORT}}}\.?$"))
    name = F.lower(F.rtrim("w", F.lit(".")))
    counted = each.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.count_if(F.endswith("w", F.lit("."))).alias("dotted"), F.count_if(F.endswith("w", F.lit(".")) & F.col("low")).alias("on"))
    return counted.where((F.col("dotted") > 1) & (F.col("dotted") * 100 >= F.col("n") * DOTTED) & (F.col("on") * 100 >= F.col("dotted") * GOES_ON)).select("name")


def ends(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, cuts): the places of the words that end sentences, in order; only words with a mark at their end are looked at."""
    after = lambda ws, i: F.coalesce(F.get(ws, i + 1), F.lit(""))
    marks = let(words(F.col("text")), lambda ws: F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("at"), w.alias("w"), after(ws, i).rlike(r"^\p{Ll}").alias("low"))), lambda x: x["w"].rlike(END) & ~x["low"]))
    each = docs.where("text is not null").select("doc_id", F.inline(marks)).select("doc_id", "at", F.lower(F.rtrim("w", F.lit("."))).alias("name"), F.col("w").rlike(r"^\p{L}+\.$").alias("plain"))
    kept = each.join(known.withColumn("plain", F.lit(True)), ["name", "plain"], "left_anti")
    return kept.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("cuts"))


def windows(docs: DataFrame, per_window: int, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, window, sentences, text): runs of so many sentences; doc_ids are distinct, texts without words have none."""
    known = abbreviations(docs) if known is None else known
    joined = docs.where("text is not null").select("doc_id", words(F.col("text")).alias("w")).where("size(w) > 0").join(ends(docs, known), "doc_id", "left")
    last = F.size("w") - 1
    # The last word ends a sentence, whatever it is.
    cuts = F.array_distinct(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array(last)))
    each = joined.select("doc_id", "w", cuts.alias("cuts")).select("doc_id", "w", "cuts", F.posexplode(F.sequence(F.lit(0), F.size("cuts") - 1, F.lit(per_window))).alias("window", "first"))
    begin = F.when(F.col("first") == 0, 0).otherwise(F.get("cuts", F.col("first") - 1) + 1)
    stop = F.least(F.col("first") + per_window, F.size("cuts")) - 1
    text = F.array_join(F.slice("w", begin + 1, F.get("cuts", stop) - begin + 1), " ")
    return each.select("doc_id", F.col("window").cast("long").alias("window"), (stop - F.col("first") + 1).cast("long").alias("sentences"), text.alias("text"))
