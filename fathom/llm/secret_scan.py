"""Secret scans over a trigram inverted index.

Each rule's regular expression yields a Boolean query over lower-case trigrams that every match must hold.
The index is a table of postings (trigram, doc_id) for the trigrams that some query names; intersecting
postings per document leaves the rules that may match there, and only those are verified on the text. Rules
without a mandatory trigram scan every text. All of it is DataFrame expressions.

Null texts count as empty and have no spans. Repeated rows are scanned each; a null doc_id is a key like
any other. Offsets count code points, the end exclusive. Texts are scanned whole.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import let
from fathom.llm.common import may_be_among, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the group that must have a least number of characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base kinds, in the order in which they are listed; their patterns are fixed values.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
)
#: Formats of tokens that services publish; fixed values.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("url_password", r"[a-z][a-z0-9+]{1,12}://[A-Za-z0-9._-]+:[^\x00-\x20/@:]{3,}@"),
)
RULES = BASE + EXTRA

#: A run of literals is followed in at most so many spellings; beyond it the run is cut, which weakens the query only.
MOST_SPELLINGS = 24

# A query is ("any",), ("gram", trigram), ("and", queries) or ("or", queries).
ANY = ("any",)


def _both(queries: list[tuple]) -> tuple:
    kept = list(dict.fromkeys(q for q in queries if q != ANY))
    return ANY if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _either(queries: list[tuple]) -> tuple:
    flat = lambda q: {q} if q[0] == "gram" else set(q[1])
    every = list(dict.fromkeys(queries))
    # An alternative that asks for all that another one asks for, and more, adds nothing.
    kept = [q for q in every if q == ANY or not any(o != q and o[0] != "or" and q[0] != "or" and flat(o) < flat(q) for o in every if o != ANY)]
    return ANY if not kept or ANY in kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _grams(spellings: set[str]) -> tuple:
    return _either([_both([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(spellings)])


def _spellings(op, value) -> set[str] | None:
    """The strings that a node stands for, in lower case, if they are few."""
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN and all(k is sre.LITERAL for k, _ in value):
        found = {chr(v).lower() for _, v in value}
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _product(value[3])
    if op is sre.BRANCH:
        parts = [_product(x) for x in value[1]]
        return None if None in parts or sum(map(len, parts)) > MOST_SPELLINGS else set().union(*parts)
    if op is sre.MAX_REPEAT and value[1] == 1:
        part = _product(value[2])
        return None if part is None else part | ({""} if value[0] == 0 else set())
    return None


def _product(nodes) -> set[str] | None:
    found = {""}
    for op, value in nodes:
        part = _spellings(op, value)
        if part is None or len(found) * len(part) > MOST_SPELLINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def _query(nodes) -> tuple:
    queries, run = [], {""}
    for op, value in nodes:
        part = _spellings(op, value)
        if part is not None and len(run) * len(part) <= MOST_SPELLINGS:
            run = {a + b for a in run for b in part}
            continue
        queries.append(_grams(run))
        run = {""}
        if part is not None:
            run = part
        elif op is sre.SUBPATTERN:
            queries.append(_query(value[3]))
        elif op is sre.BRANCH:
            queries.append(_either([_query(x) for x in value[1]]))
        elif op is sre.MAX_REPEAT and value[0] > 0:
            queries.append(_query(value[2]))
    return _both([*queries, _grams(run)])


def trigram_query(pattern: str) -> tuple:
    """The Boolean query of lower-case trigrams that every match of a pattern satisfies."""
    return _query(parser.parse(pattern))


def trigrams_of(query: tuple) -> set[str]:
    """The trigrams that a query names."""
    if query[0] == "gram":
        return {query[1]}
    return set().union(*map(trigrams_of, query[1])) if len(query) > 1 else set()


def _holds(query: tuple, grams: Column) -> Column:
    if query[0] == "gram":
        return F.array_contains(grams, query[1])
    parts = [_holds(q, grams) for q in query[1]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(trigram, doc_id) for each trigram of the vocabulary in each lower-cased text."""
    lowered = docs.select("doc_id", F.lower("text").alias("t"))
    present = F.filter(F.array(*map(F.lit, vocabulary)), lambda g: F.contains(F.col("t"), g))
    return lowered.select("doc_id", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and the kinds whose trigram query its postings satisfy."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    vocabulary = sorted(set().union(*map(trigrams_of, queries.values())))
    grouped = postings(docs, vocabulary).groupBy("doc_id").agg(F.collect_set("trigram").alias("grams"))
    kinds = F.array_compact(F.array(*(F.when(_holds(q, F.col("grams")), k) for k, q in queries.items())))
    return grouped.select("doc_id", kinds.alias("may")).where(F.size("may") > 0)


def _totals(steps: Column, first: Column) -> Column:
    """first and its running totals over an array; meant for about a square root of a text's matches."""
    return F.aggregate(steps, F.array(first), lambda done, step: F.array_append(done, F.element_at(done, -1) + step))


def _running(steps: Column) -> Column:
    """The running totals of an array.

    An append copies an array, so the totals are taken within runs of a square root of its length, then over the
    runs: a text of n matches takes n ** 1.5 cheap steps.
    """
    width = F.greatest(F.ceil(F.sqrt(F.size(steps))).cast("int"), F.lit(1))

    def over(runs: Column) -> Column:
        before = _totals(F.transform(runs, lambda run: F.element_at(run, -1)), F.lit(0))
        return F.flatten(F.zip_with(runs, F.slice(before, F.lit(1), F.size(runs)), lambda run, start: F.transform(run, lambda x: x + start)))

    runs = F.transform(F.sequence(F.lit(1), F.size(steps), width), lambda i: F.slice(_totals(F.slice(steps, i, width), F.lit(0)), F.lit(2), width))
    return F.when(F.size(steps) > 0, let(runs, over)).otherwise(F.array().cast("array<int>"))


def _spans(rule: Rule, text: Column) -> Column:
    """The spans of a rule's matches as array<struct<start, end>>; the gaps between them come from split."""
    pattern = F.lit(rule.pattern)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    enough = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)

    def placed(n: Column) -> Column:
        ends = let(F.zip_with(F.slice(gaps, F.lit(1), F.size(n)), n, lambda gap, m: gap + m), _running)
        return F.zip_with(ends, n, lambda end, m: F.struct((end - m).alias("start"), end.alias("end")))

    kept = F.zip_with(let(sizes, placed), enough, lambda span, ok: F.when(ok, span))
    return F.filter(kept, lambda span: span.isNotNull())


def _labelled(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and its spans, array<struct<start, order, kind, end>> by start, then by the rules' order."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # A class repeated at least n times has the same matches of n or more characters as that class repeated.
    rules = tuple(Rule(r.kind, re_least(r), r.group, 1 if re_least(r) != r.pattern else r.least, r.base) for r in rules)
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != ANY)
    if indexed:
        found, _ = written(candidates(docs, indexed).withColumnRenamed("doc_id", "key"))
        # Texts that no candidate can name stay where they are; only the others meet the candidates.
        marked = may_be_among(docs.withColumn("place", F.xxhash64("doc_id")), found.select(F.xxhash64("key").alias("place")), "place", "mark")
        few = marked.where("mark").join(found, F.col("doc_id").eqNullSafe(F.col("key")), "left").select("doc_id", "text", "may")
        docs = few.unionByName(marked.where("not mark").select("doc_id", "text", F.lit(None).cast("array<string>").alias("may")))
    parts = []
    for order, rule in enumerate(rules):
        verified = _spans(rule, F.col("text"))
        none = F.lit(None).cast("array<struct<start:int,end:int>>")
        scanned = F.when(F.array_contains("may", rule.kind), verified).otherwise(none) if rule in indexed else F.when(F.col("text").rlike(rule.pattern), verified).otherwise(none)
        parts.append(_labelled(F.coalesce(scanned, F.array().cast("array<struct<start:int,end:int>>")), order, rule.kind))
    return docs.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def re_least(rule: Rule) -> str:
    """A one-class pattern with its least length written into it; other patterns stay."""
    one = parser.parse(rule.pattern)
    if rule.group == 0 and rule.least > 1 and len(one) == 1 and one[0][0] is sre.MAX_REPEAT and rule.pattern.endswith("]+"):
        return f"{rule.pattern[:-1]}{{{rule.least},}}"
    return rule.pattern


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and digest of the base spans, and all spans."""
    found = scan(docs)
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter(spans, lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def oracle() -> str:
    """DuckDB SQL of digests() over the table documents."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [
        f"SELECT doc_id, {order} AS ord, {quoted(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS v, regexp_split_to_array(t, {quoted(r.pattern)}) AS p FROM d"
        for order, r in enumerate(RULES)
    ]
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {quoted(r.kind)}) AS n_{r.kind}" for r in BASE)
    join = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT doc_id, ord, kind, least, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT doc_id, ord, kind, length(m[i]) AS n, length(v[i]) >= least AS ok,
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM each),
kept AS (SELECT doc_id, ord, kind, s, s + n AS e FROM placed WHERE ok),
summed AS (SELECT doc_id, {counts}, {join.format(f" FILTER (WHERE ord < {len(BASE)})")} AS base, {join.format("")} AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN summed ON d.doc_id IS NOT DISTINCT FROM summed.doc_id"""
