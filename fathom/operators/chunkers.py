"""Chunkers for HTML, Markdown, JSON, CSV rows, plain text and timed events."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.functions.text import let, tokens
from fathom.operators import ordered
from fathom.sources.store import written

#: What goes before blocks are cut.
NOISE = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCK = r"(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>"


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, text): headings, paragraphs and list items in order, without inner tags."""
    clean = pages.select("page_id", F.regexp_replace("html", NOISE, "").alias("h"))
    both = F.arrays_zip(F.regexp_extract_all("h", F.lit(BLOCK), F.lit(1)).alias("tag"), F.regexp_extract_all("h", F.lit(BLOCK), F.lit(2)).alias("body"))
    each = clean.select("page_id", F.posexplode(both).alias("pos", "b"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("b.body"), r"(?s)<[^>]*>", ""), r"\s+", " "))
    return each.select("page_id", F.col("pos").cast("long").alias("pos"), F.lower("b.tag").alias("tag"), text.alias("text"))


def html_markdown(blocks: DataFrame) -> DataFrame:
    """(page_id, pos, text, section): blocks as Markdown, and the heading block that each belongs to."""
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    mark = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).when(F.col("tag") == "li", "- ").otherwise("")
    w = W.partitionBy("page_id").orderBy("pos")
    return blocks.select("page_id", "pos", F.concat(mark, "text").alias("text"), F.last(F.when(level.isNotNull(), F.col("pos")), True).over(w).alias("section"))


def markdown_sections(docs: DataFrame, heading: str = r"^#{1,6} ") -> DataFrame:
    """(doc_id, section, lines, chars): lines from one heading to the next."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    w = W.partitionBy("doc_id").orderBy("pos")
    numbered = lines.withColumn("section", F.sum(F.col("line").rlike(heading).cast("long")).over(w))
    return numbered.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def json_fields(events: DataFrame, column: str = "props") -> DataFrame:
    """(event_id, key, value): the top-level fields of a JSON object."""
    return events.select("event_id", F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def token_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, window, start, text): windows of tokens that overlap."""
    toks = docs.select("doc_id", tokens(F.col("text")).alias("t")).where("size(t) > 0")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("t") - overlap - 1), F.lit(step))
    each = toks.select("doc_id", "t", F.posexplode(starts).alias("window", "start"))
    return each.select("doc_id", F.col("window").cast("long").alias("window"), F.col("start").cast("long").alias("start"), F.array_join(F.slice("t", F.col("start") + 1, F.lit(size)), " ").alias("text"))


def row_groups(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds chunk, the number of each row's run of so many rows within a group."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) / size).cast("long"))


def sized_row_groups(rows: DataFrame, group: str, order: str, length: Column, per_chunk: int, least: int = 5120) -> DataFrame:
    """Adds chunk: runs of rows that end with the row by which they are as long as max(least, mean length * per_chunk).

    Rows lie in ranges. A run that is open at a range's begin ends within the range at one of its first rows, a run's
    length of them at most; for each of these a range tells in one pass how many runs follow and where its last run
    began. One task then goes from range to range through these few rows, and each range numbers its own rows. The
    order has no ties; null lengths count as 0.
    """
    sized = rows.withColumn("_len", F.coalesce(length, F.lit(0)).cast("long"))
    mean = sized.groupBy(group).agg(F.greatest(F.lit(float(least)), F.avg("_len") * per_chunk).alias("_size"))
    ranged = ordered.laid(sized.join(mean, group), [group, order])
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    begins = ranged.groupBy(group, "_range").agg(F.sum("_len").alias("_sum")).select(group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_begin"))
    within = W.partitionBy(group, "_range").orderBy(order)
    summed = ranged.join(begins, [group, "_range"]).withColumn("_upto", F.col("_begin") + F.sum("_len").over(within)).withColumn("_pos", F.row_number().over(within).cast("long"))
    summed = written(summed)
    kind = summed.schema[group].dataType.simpleString()
    passes = written(summed.groupBy(group, "_range").applyInPandas(_passes(group), f"`{group}` {kind}, _range int, upto long, runs long, base long, size double"))
    opened = written(passes.groupBy(group).applyInPandas(_open_runs(group), f"`{group}` {kind}, _range int, base long, chunk long"))
    starts = summed.join(opened, [group, "_range"]).groupBy(group, "_range").applyInPandas(_starts(group), f"`{group}` {kind}, _range int, _pos long, _start long")
    marked = summed.join(opened.select(group, "_range", "chunk"), [group, "_range"]).join(starts, [group, "_range", "_pos"], "left")
    return marked.withColumn("chunk", F.col("chunk") + F.coalesce(F.sum("_start").over(within), F.lit(0))).select(*rows.columns, "chunk")


def _ends(upto: np.ndarray, base: int, size: float) -> int:
    """The first row by which a run that began after base is full; the number of rows if none is. Of doubles, else each search would convert them all."""
    return int(upto.searchsorted(float(base) + size))


def _passes(group: str) -> Callable:
    def passes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        upto, size = rows["_upto"].to_numpy(float), float(rows["_size"].iloc[0])
        count = min(len(upto), _ends(upto, rows["_begin"].iloc[0], size) + 1)
        known: dict[int, tuple[int, int]] = {}  # a row that ends a run: runs that end from it on, and where the last one ends
        for end in range(count):
            path = []
            while end < len(upto) and end not in known:
                path.append(end)
                end = _ends(upto, upto[end], size)
            runs, base = known[end] if end < len(upto) else (0, int(upto[path[-1]]) if path else 0)
            for x in reversed(path):
                runs += 1
                known[x] = (runs, base)
        found = [known[x] for x in range(count)]
        return pd.DataFrame({group: rows[group].iloc[0], "_range": rows["_range"].iloc[0], "upto": upto[:count].astype(int), "runs": [r for r, _ in found], "base": [b for _, b in found], "size": size})

    return passes


def _open_runs(group: str) -> Callable:
    def opened(rows: pd.DataFrame) -> pd.DataFrame:
        out, base, chunk = [], 0, 0
        for at, own in rows.sort_values(["_range", "upto"], kind="stable").groupby("_range", sort=True):
            out.append((at, base, chunk))
            end = _ends(own["upto"].to_numpy(float), base, own["size"].iloc[0])
            if end < len(own):
                base, chunk = int(own["base"].iloc[end]), chunk + int(own["runs"].iloc[end])
        found = pd.DataFrame(out, columns=["_range", "base", "chunk"])
        found.insert(0, group, rows[group].iloc[0])
        return found

    return opened


def _starts(group: str) -> Callable:
    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        upto, size, at = rows["_upto"].to_numpy(float), float(rows["_size"].iloc[0]), []
        end = _ends(upto, rows["base"].iloc[0], size)
        while end < len(upto) - 1:
            at.append(end + 2)  # positions count from one, and a run begins behind the row that ends the last one
            end = _ends(upto, upto[end], size)
        return pd.DataFrame({group: rows[group].iloc[0], "_range": rows["_range"].iloc[0], "_pos": np.array(at, int), "_start": 1})

    return starts


def gap_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(user_id, session, n, first_ts, last_ts): events with no gap between them above a limit."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    marked = events.withColumn("new", F.coalesce((seconds > gap_seconds).cast("long"), F.lit(0)))
    return marked.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


#: Tags that begin or end a block, and what stands around them while blocks are cut.
STRUCTURE = r"(?is)<(/?)(h[1-6]|p|li|div|table|tr|td|th|ul|ol|nav|article|body|head|html|title)(?:\s[^>]*)?>"
OPEN, CLOSE = "\x01", "\x02"


def html_outline(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, text, parent): texts by the tag that they follow, with the heading that each belongs to.

    Text after an end tag has the tag `body`. A heading's parent is the last one of a lower level, and that of other
    blocks is the last heading, both by position; what precedes all headings has none.
    """
    marked = pages.select("page_id", F.regexp_replace(F.regexp_replace("html", NOISE, ""), STRUCTURE, f"{OPEN}$1$2{CLOSE}").alias("h"))
    each = marked.select("page_id", F.posexplode(F.split("h", OPEN)).alias("pos", "piece")).select("page_id", F.col("pos").cast("long").alias("pos"), F.split("piece", CLOSE, 2).alias("p"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.element_at("p", -1), r"(?s)<[^>]*>", ""), r"\s+", " "))
    tag = F.when((F.size("p") < 2) | F.startswith(F.get("p", F.lit(0)), F.lit("/")), "body").otherwise(F.lower(F.get("p", F.lit(0))))
    blocks = each.select("page_id", "pos", tag.alias("tag"), text.alias("text")).where("text <> ''")
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    leveled = blocks.withColumn("level", level)
    above = lambda k: F.last(F.when(F.col("level") < k, F.col("pos")), True).over(w)
    parent = F.coalesce(*(F.when(F.col("level") == k, above(k)) for k in range(1, 7)), F.when(F.col("level").isNull(), above(7)))
    return leveled.select("page_id", "pos", "tag", "text", parent.alias("parent"))


def html_table_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, tbl, row, markdown): the rows of the tables of pages, with bars; tables do not nest."""
    both = lambda text, tag: F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    tables = pages.select(key, F.posexplode(both(F.col("html"), "table")).alias("tbl", "t"))
    rows = tables.select(key, "tbl", F.posexplode(both(F.col("t"), "tr")).alias("row", "r"))
    cells = F.transform(both(F.col("r"), "t[dh]"), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"\s+", " ")))
    return rows.select(key, F.col("tbl").cast("long").alias("tbl"), F.col("row").cast("long").alias("row"), F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("markdown"))


def json_paths(rows: DataFrame, key: str, column: str, depth: int = 4) -> DataFrame:
    """(key, path, value): the leaves of nested JSON, objects by name and arrays by place, down to some depth.

    Each level is one explode of what is still an object or an array; values below the last level stay JSON.
    """
    now = rows.select(key, F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    out = None
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    for _ in range(depth):
        leaves = now.where(~nested).select(key, "path", F.col("v").cast("string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        now = now.where(nested).select(key, "path", F.col("v").alias("box")).lateralJoin(_entries()).select(key, F.concat("path", F.when(F.col("k").isNull(), F.concat(F.lit("["), F.col("at").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("k")))).alias("path"), "v")
    return out.unionByName(now.select(key, "path", F.when(nested, F.to_json("v")).otherwise(F.col("v").cast("string")).alias("value")))


def _entries() -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    return spark.tvf.variant_explode(F.col("box").outer()).toDF("at", "k", "v")


def markdown_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, kind, text): headings, fenced code and paragraphs of Markdown, in order.

    A heading is a line of its own, code runs from fence to fence with blank lines kept, a paragraph to the next blank
    line, heading or fence.
    """
    lines = docs.select(key, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    w = W.partitionBy(key).orderBy("pos")
    fence = F.startswith("line", F.lit("```"))
    fenced = lines.withColumn("fences", F.count_if(fence).over(w)).withColumn("code", (F.col("fences") % 2 == 1) | fence)
    kind = F.when(F.col("code"), "code").when(F.col("line").rlike("^#{1,6} "), "heading").when(F.trim("line") == "", "blank").otherwise("paragraph")
    kinds = fenced.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    opens = F.col("before").isNull() | (F.col("kind") != F.col("before")) | (F.col("kind") == "heading") | ((F.col("kind") == "code") & fence & (F.col("fences") % 2 == 1))
    numbered = kinds.withColumn("block", F.count_if(opens).over(w)).where("kind <> 'blank'")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return numbered.groupBy(key, "block", "kind").agg(ordered.alias("o")).select(key, "block", "kind", F.array_join("o.line", "\n").alias("text"))


def paragraphs(docs: DataFrame, key: str = "doc_id", lines: int = 0) -> DataFrame:
    """(key, para, text): pieces of plain text between blank lines, or windows of so many lines if it has no blank line."""

    def windows(text: Column) -> Column:
        every = F.split(text, "\n", -1)
        return let(every, lambda ls: F.transform(F.sequence(F.lit(1), F.size(ls), F.lit(lines)), lambda i: F.array_join(F.slice(ls, i, F.lit(lines)), "\n")))

    pieces = F.filter(F.transform(F.split("text", r"\n[ \t]*\n\s*", -1), lambda p: F.trim(p)), lambda p: p != "")
    if lines:
        pieces = F.when(F.col("text").rlike(r"\n[ \t]*\n"), pieces).otherwise(windows(F.col("text")))
    each = docs.where("text is not null").select(key, F.posexplode(pieces).alias("para", "text"))
    return each.select(key, F.col("para").cast("long").alias("para"), "text")
