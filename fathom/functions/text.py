"""Text predicates and transforms as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the edges: Unicode spaces, not the blank alone.
EDGES = r"(?U)^\s+|\s+$"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f names it, also within a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at the edges; x is named several times. Only strings that have some pay for the search."""
    return F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(x, EDGES, "")).otherwise(x)


def alnum_count(x: Column) -> Column:
    """Letters and digits in a string."""
    return F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))


def is_valid_text(x: Column) -> Column:
    """More than 20 characters after stripping, and a letter."""
    return F.coalesce((F.length(strip(x)) > 20) & x.rlike(r"\p{L}"), F.lit(False))


def is_valid_line(x: Column) -> Column:
    """At least 5 characters after stripping, of which 60 % are letters or digits."""
    s = strip(x)
    return F.coalesce((F.length(s) >= 5) & (alnum_count(s) * 10 >= F.length(s) * 6), F.lit(False))


def needs_ocr(text: Column, force: bool = False, disable: bool = False) -> Column:
    """Whether a page has to be read from its image."""
    return F.lit(False) if disable else F.lit(True) if force else ~is_valid_text(text)


def tokens(x: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def seed_tokens(x: Column) -> Column:
    """Query words for entity linking: split at white space, longer than 2 characters, then lower case."""
    return F.transform(F.filter(F.split(x, r"\s+"), lambda t: F.length(t) > 2), F.lower)


def extension(key: Column) -> Column:
    """What follows the last dot, in lower case; the whole key if there is none."""
    return F.lower(F.element_at(F.split(key, r"\."), -1))


def distinct_lines(lines: Column) -> Column:
    """Order-preserving: the first spelling of each line, compared without case; meant for page-sized arrays."""
    first = lambda ls, keys: F.filter(ls, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return let(lines, lambda ls: let(F.transform(ls, F.lower), lambda keys: first(ls, keys)))


def cell(x: Column) -> Column:
    """A table cell: null becomes empty, line ends become blanks, edges are stripped."""
    return let(F.regexp_replace(F.coalesce(x, F.lit("")), "\n", " "), strip)


def is_valid_table(rows: Column) -> Column:
    """At least 2 rows, 2 cells in the first, and letters in at least half of all cells."""
    cells = F.flatten(rows)
    lettered = F.size(F.filter(cells, lambda c: F.coalesce(c, F.lit("")).rlike(r"\p{L}")))
    return F.coalesce((F.size(rows) >= 2) & (F.size(F.get(rows, F.lit(0))) >= 2) & (lettered * 2 >= F.size(cells)), F.lit(False))


def table_markdown(rows: Column) -> Column:
    """Header, rule and body rows with bars."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    head = F.get(rows, F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(line(head), rule), body), "\n")


def scale_pixels(x: Column, pixels: Column, points: Column) -> Column:
    """A page coordinate in pixels, cut to a whole number."""
    return (x * pixels / points).cast("int")


def clamp_length(requested: Column, default: int, longest: int) -> Column:
    """A requested length between 1 and the longest; what is no number asks for the default."""
    return F.greatest(F.lit(1), F.least(F.coalesce(requested.try_cast("int"), F.lit(default)), F.lit(longest)))


def tokenizer_limit(x: Column) -> Column:
    """A tokenizer's own limit; sizes that mean "none" become 8192."""
    return F.when((x <= 0) | (x > 1_000_000), 8192).otherwise(x)


def hop_score(hop: Column) -> Column:
    """Nearer vertices score higher."""
    return F.lit(1.0) / (F.lit(1.0) + hop)


def utc_stamp(ts: Column) -> Column:
    """ISO-8601 with a Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def truncate(words: Column, limit: Column) -> Column:
    """The first tokens of a text, by its own limit."""
    return F.slice(words, F.lit(1), limit)


def image_large_enough(width: Column, height: Column, least: int = 50) -> Column:
    """Whether an image, in pixels, is worth reading."""
    return F.coalesce((width >= least) & (height >= least), F.lit(False))
