"""Pages: lines to page chunks, words to lines, layout merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.config import IngestConfig
from fathom.functions.text import distinct_lines, is_valid_line, let, strip


def unique_documents(docs: DataFrame) -> DataFrame:
    """(document_id, doc_id, text): one document for each content hash, the one of the least id."""
    hashed = docs.where("text is not null").select(F.md5("text").alias("document_id"), "doc_id")
    first = hashed.groupBy("document_id").agg(F.min("doc_id").alias("doc_id"))
    return docs.select("doc_id", "text").join(first, "doc_id").select("document_id", "doc_id", "text")


def page_text(lines: Column, page: Column, keep_markup: bool = False) -> Column:
    """A page's text: header and lines, stripped, without blanks, poor lines and repeats."""
    header = F.concat(F.lit("## Page "), page.cast("string"))
    every = F.filter(F.transform(F.concat(F.array(header), lines), strip), lambda x: x != "")
    markup = (lambda x: x.startswith("## Page ") | x.rlike(r"^[|\s-]+$")) if keep_markup else (lambda x: F.lit(False))
    return F.array_join(distinct_lines(F.filter(every, lambda x: is_valid_line(x) | markup(x))), "\n\n")


def assemble_pages(documents: DataFrame, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """(chunk_id, document_id, page_number, text): fixed windows of lines; no shuffle.

    A document's pages are made within its row, each from its own lines, so that long documents take linear time.
    """
    n = cfg.lines_per_page
    page = lambda lines, p: F.struct(p.cast("long").alias("page_number"), page_text(F.slice(lines, (p - 1) * n + 1, F.lit(n)), p, cfg.keep_markup).alias("text"))
    every = let(F.split("text", "\n", -1), lambda lines: F.transform(F.sequence(F.lit(1), F.ceil(F.size(lines) / n).cast("int")), lambda p: page(lines, p)))
    each = documents.select("document_id", F.inline(every))
    return each.select(F.concat("document_id", F.lit("_"), F.col("page_number").cast("string")).alias("chunk_id"), "document_id", "page_number", "text")


def page_numbers(documents: DataFrame, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """(chunk_id, document_id, page_number) of the pages that assemble_pages makes, from the number of lines alone."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    each = documents.select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(lines / cfg.lines_per_page))).alias("page_number"))
    return each.select(F.concat("document_id", F.lit("_"), F.col("page_number").cast("string")).alias("chunk_id"), "document_id", "page_number")


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): the first of each document's lines that are equal but for case and edges."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("line", strip(F.col("line"))).withColumn("key", F.lower("line")).where("key <> ''")
    first = keyed.groupBy("doc_id", "key").agg(F.min(F.struct("pos", "line")).alias("f"))
    return first.select("doc_id", F.col("f.pos").cast("long").alias("pos"), "f.line")


def words_to_lines(words: DataFrame) -> DataFrame:
    """(page, top, line): words of one height, by x; heights are rounded half to even."""
    grouped = words.withColumn("top", F.bround("top", 1)).groupBy("page", "top").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"))
    return grouped.select("page", "top", F.array_join("w.text", " ").alias("line"))


def merge_layout(items: DataFrame) -> DataFrame:
    """(page, text): items of a page by height, then kind, then place; tables and whole-page text lie at 0."""
    kind = F.when(F.col("kind") == "text", 0).when(F.col("kind") == "image", 1).otherwise(2)
    top = F.when(F.col("kind") == "table", 0.0).otherwise(F.col("top"))
    ordered = F.array_sort(F.collect_list(F.struct(top.alias("top"), kind.alias("kind"), "idx", "text")))
    return items.groupBy("page").agg(ordered.alias("i")).select("page", F.array_join("i.text", "\n").alias("text"))


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of the highest order of each key; nothing but the winner of a key is held, however many rows it has."""
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row"))
    return best.select("_row.*")
