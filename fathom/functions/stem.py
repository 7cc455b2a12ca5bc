"""A suffix-rule stemmer for the text_en analyzer: applied to the distinct words of a vocabulary and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (suffix, what takes its place, letters that must be left before it); the first rule that fits is applied, plurals first.
PLURALS = (("sses", "ss", 1), ("ies", "y", 2), ("xes", "x", 2), ("ches", "ch", 2), ("shes", "sh", 2), ("ss", "ss", 0), ("us", "us", 0), ("is", "is", 0), ("s", "", 3))
ENDINGS = (
    ("ization", "ize", 3), ("ational", "ate", 3), ("fulness", "ful", 2), ("iveness", "ive", 2), ("ousness", "ous", 2), ("ability", "able", 2), ("ements", "", 4),
    ("ement", "", 4), ("ingly", "", 3), ("edly", "", 3), ("ation", "ate", 3), ("tional", "tion", 3), ("ness", "", 3), ("ally", "al", 3), ("ying", "y", 2),
    ("ing", "", 3), ("ied", "y", 2), ("ed", "", 3), ("ly", "", 3), ("er", "", 4), ("est", "", 4),
)


def _apply(word: Column, rules: tuple) -> Column:
    out = None
    for suffix, instead, least in rules:
        fits = F.endswith(word, F.lit(suffix)) & (F.length(word) >= len(suffix) + least)
        made = F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(instead))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out.otherwise(word)


def stem(word: Column) -> Column:
    """The stem of a word in lower case: a plural's ending goes, then one derivational or inflectional ending."""
    return F.get(F.transform(F.array(_apply(word, PLURALS)), lambda w: _apply(w, ENDINGS)), F.lit(0))


def stem_sql(word: str) -> str:
    """The same rules as DuckDB SQL."""
    def case(x: str, rules: tuple) -> str:
        arms = " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) >= {len(s) + least} THEN {x}[:length({x}) - {len(s)}] || '{instead}'" for s, instead, least in rules)
        return f"(CASE {arms} ELSE {x} END)"

    return f"list_transform([{case(word, PLURALS)}], lambda w: {case('w', ENDINGS)})[1]"


def stems(vocabulary: DataFrame) -> DataFrame:
    """(token, stem) of each distinct token."""
    return vocabulary.select("token").distinct().select("token", stem(F.col("token")).alias("stem"))
