"""The tree of HTML elements from prefix sums and windows over a page's tags.

Scripts, styles, comments and declarations go first. An end tag closes the last start tag of its name that is still
open; one without such a start tag is ignored. Void elements, and elements that no end tag closes, have no children:
what follows them belongs to the element around them. Where elements cross, an end tag closes the innermost one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.operators.chunkers import NOISE

#: Elements without an end tag: fixed values.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: A tag: its slash, its name, and attributes whose quoted values may hold any character.
TAG = r"""(?s)<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:[\s/][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)?>"""
DECLARATION = r"(?s)<![^>]*>"
OPEN, CLOSE = "\x01", "\x02"


def tags(pages: DataFrame) -> DataFrame:
    """(page_id, pos, name, shut, text): the tags of each page in order, and the text that follows each."""
    clean = F.regexp_replace(F.regexp_replace(F.translate("html", OPEN + CLOSE, ""), NOISE, ""), DECLARATION, "")
    marked = pages.select("page_id", F.split(F.regexp_replace(clean, TAG, f"{OPEN}$1$2{CLOSE}"), OPEN, -1).alias("pieces"))
    each = marked.select("page_id", F.posexplode("pieces").alias("pos", "piece")).where("pos > 0").select("page_id", F.col("pos").cast("long").alias("pos"), F.split("piece", CLOSE, 2).alias("p"))
    mark = F.lower(F.get("p", F.lit(0)))
    text = F.trim(F.regexp_replace(F.get("p", F.lit(1)), r"\s+", " "))
    return each.select("page_id", "pos", F.ltrim(mark, F.lit("/")).alias("name"), mark.startswith("/").alias("shut"), text.alias("text"))


def matched(found: DataFrame) -> DataFrame:
    """Adds pair, whether a start tag has its end tag or an end tag its start tag."""
    by = W.partitionBy("page_id", "name").orderBy("pos")
    level = F.sum(F.when(F.col("shut"), -1).otherwise(1)).over(by)
    # End tags beyond the start tags make the sum fall to a new least value below zero; they do not count.
    deep = found.where(~F.col("name").isin(*VOID)).withColumn("sum", level).withColumn("least", F.least(F.lit(0), F.min("sum").over(by)))
    before = F.coalesce(F.lag("least").over(by), F.lit(0))
    counted = deep.withColumn("stray", F.col("shut") & (F.col("least") < before)).withColumn("level", F.col("sum") - F.col("least") + F.col("shut").cast("int"))
    # Tags of one level of a name follow each other as start, end, start, end; a start before another start is unclosed.
    same = W.partitionBy("page_id", "name", "level", "stray").orderBy("pos")
    pair = ~F.col("stray") & F.when(F.col("shut"), True).otherwise(F.coalesce(F.lead("shut").over(same), F.lit(False)))
    known = counted.select("page_id", "pos", "name", "shut", "text", pair.alias("pair"))
    return known.unionByName(found.where(F.col("name").isin(*VOID)).withColumn("pair", F.lit(False)))


def tree(pages: DataFrame) -> DataFrame:
    """(page_id, pos, name, depth, parent, closed, text) of every element: parent is the position of the one around it."""
    rows = matched(tags(pages))
    change = F.when(F.col("pair"), F.when(F.col("shut"), -1).otherwise(1)).otherwise(0)
    nested = rows.withColumn("depth", F.sum(change).over(W.partitionBy("page_id").orderBy("pos")))
    nodes = nested.where(~F.col("shut")).withColumn("depth", (F.col("depth") - F.col("pair").cast("int")).cast("long"))
    # An element is looked for by those one level below, so each stands in its own level and, asking, in the one above.
    both = nodes.withColumn("asks", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("level", F.col("depth") - F.col("asks").cast("int"))
    holder = F.last(F.when(~F.col("asks") & F.col("pair"), F.col("pos")), True).over(W.partitionBy("page_id", "level").orderBy("pos", "asks").rowsBetween(W.unboundedPreceding, -1))
    return both.withColumn("parent", holder).where("asks").select("page_id", "pos", "name", "depth", "parent", F.col("pair").alias("closed"), "text")
