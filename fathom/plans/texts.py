"""Queries of text kernels and chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import chunkers, pages, sentences
from fathom.plans import tables
from fathom.plans.registry import query
from fathom.session import load

_LINES = "ls AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ALNUM = r"length(regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_S = _STRIP.format("line")


@query(f"WITH {_LINES} SELECT doc_id, count(*) FILTER (WHERE length({_S}) >= 5 AND {_ALNUM.format(_S)} * 10 >= length({_S}) * 6) AS valid_lines, count(*) AS lines FROM ls GROUP BY doc_id")
def valid_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that read like text, counted within each row."""
    lines = F.split("text", "\n", -1)
    return tables.docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(F.filter(lines, T.is_valid_line)).cast("long").alias("valid_lines"), F.size(lines).cast("long").alias("lines"))


@query(f"WITH {_LINES}, s AS (SELECT doc_id, pos, {_S} AS line FROM ls) SELECT doc_id, pos, line FROM s WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) = 1")
def line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document without repeats."""
    return pages.dedupe_lines(tables.docs(spark, sf_dir).where("text is not null"))


@query(f"""WITH {_LINES}, h AS (SELECT page_id, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS pos, unnest(string_split(html, chr(10))) AS line FROM pages WHERE html IS NOT NULL),
every_line AS (SELECT 'text' AS kind, doc_id AS id, pos, line FROM ls UNION ALL SELECT 'html', page_id, pos, line FROM h) SELECT kind, id, pos, {_S} AS line, length(line) - length({_S}) AS cut FROM every_line""")
def ws_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents and web pages without white space at its edges, and how much of it was cut."""
    lines = lambda kind, rows, key, text: rows.where(F.col(text).isNotNull()).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    every = lines("text", tables.docs(spark, sf_dir), "doc_id", "text").unionByName(lines("html", load(spark, sf_dir, "pages"), "page_id", "html"))
    stripped = every.select("kind", "id", F.col("pos").cast("long").alias("pos"), T.strip(F.col("line")).alias("line"), F.length("line").alias("n"))
    return stripped.select("kind", "id", "pos", "line", (F.col("n") - F.length("line")).cast("long").alias("cut"))


_TABLES = r"""t AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: list_transform(string_split(x, '|'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g'))) AS r FROM documents WHERE contains(text, '|')),
v AS (SELECT doc_id, r, len(r) >= 2 AND len(r[1]) >= 2 AND len(list_filter(flatten(r), lambda c: regexp_matches(c, '\p{L}'))) * 2 >= len(flatten(r)) AS valid FROM t)"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.filter(F.split("text", "\n", -1), lambda x: F.contains(x, F.lit("|")))
    cells = F.transform(rows, lambda x: F.transform(F.split(x, r"\|", -1), T.strip))
    return tables.docs(spark, sf_dir).where(F.contains("text", F.lit("|"))).select("doc_id", cells.alias("r"))


@query(f"WITH {_TABLES} SELECT doc_id, len(r) AS n_rows, valid FROM v")
def table_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's lines with bars form a table."""
    return _tables(spark, sf_dir).select("doc_id", F.size("r").cast("long").alias("n_rows"), T.is_valid_table(F.col("r")).alias("valid"))


@query(f"""WITH {_TABLES} SELECT doc_id, '| ' || array_to_string(r[1], ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(r[1], lambda c: '---'), ' | ') || ' |' ||
CASE WHEN len(r) > 1 THEN chr(10) || array_to_string(list_transform(r[2:], lambda x: '| ' || array_to_string(x, ' | ') || ' |'), chr(10)) ELSE '' END AS markdown FROM v""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as Markdown."""
    return _tables(spark, sf_dir).select("doc_id", T.table_markdown(F.col("r")).alias("markdown"))


@query("SELECT conv_id, turn, greatest(1, least(coalesce(try_cast(CASE WHEN turn % 4 = 0 THEN 'x' WHEN turn % 4 = 1 THEN CAST(turn * 9000 AS VARCHAR) WHEN turn % 4 = 2 THEN '-5' END AS INTEGER), 100), 8192))::BIGINT AS length FROM conversations")
def clamp_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested lengths brought into range."""
    asked = F.expr("CASE WHEN turn % 4 = 0 THEN 'x' WHEN turn % 4 = 1 THEN CAST(turn * 9000 AS STRING) WHEN turn % 4 = 2 THEN '-5' END")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.clamp_length(asked, 100, 8192).cast("long").alias("length"))


_CLEAN = r"'(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->'"
_BLOCK = r"'(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>'"
_BLOCKS = rf"""c AS (SELECT page_id, regexp_replace(html, {_CLEAN}, '', 'g') AS h FROM pages),
z AS (SELECT page_id, regexp_extract_all(h, {_BLOCK}, 1) AS tags, regexp_extract_all(h, {_BLOCK}, 2) AS bodies FROM c),
b AS (SELECT page_id, generate_subscripts(tags, 1) - 1 AS pos, unnest(tags) AS tag, unnest(bodies) AS body FROM z),
blocks AS (SELECT page_id, pos, lower(tag) AS tag, trim(regexp_replace(regexp_replace(body, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM b)"""


@query(f"WITH {_BLOCKS} SELECT page_id, pos, tag, text FROM blocks")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural blocks of web pages."""
    return chunkers.html_blocks(load(spark, sf_dir, "pages"))


@query(f"""WITH {_BLOCKS} SELECT page_id, pos, CASE WHEN tag LIKE 'h_' THEN repeat('#', CAST(substr(tag, 2, 1) AS INTEGER)) || ' ' WHEN tag = 'li' THEN '- ' ELSE '' END || text AS text,
last_value(CASE WHEN tag LIKE 'h_' THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS section FROM blocks""")
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as Markdown under their headings."""
    out = chunkers.html_markdown(chunkers.html_blocks(load(spark, sf_dir, "pages")))
    return out.select("page_id", "pos", "text", F.col("section").cast("long").alias("section"))


@query(f"""WITH {_LINES}, n AS (SELECT doc_id, line, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM ls)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM n GROUP BY ALL""")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that begin at headings; short lines stand for headings in these tables."""
    return chunkers.markdown_sections(tables.docs(spark, sf_dir).where("text is not null"), r"(?s)^.{0,39}$")


@query("SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events WHERE props IS NOT NULL")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON objects as rows."""
    return chunkers.json_fields(load(spark, sf_dir, "events"))


_TOKS = r"toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM documents)"


@query(f"""WITH {_TOKS}, w AS (SELECT doc_id, t, unnest(range(0, greatest(0, len(t) - 16 - 1) + 1, 48)) AS start FROM toks WHERE len(t) > 0)
SELECT doc_id, start // 48 AS "window", start, array_to_string(t[start + 1:start + 64], ' ') AS text FROM w""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of tokens."""
    return chunkers.token_windows(tables.docs(spark, sf_dir), 64, 16)


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3 AS chunk FROM lineitem")
def row_group_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table in runs of three."""
    return chunkers.row_groups(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 3)


@query("""WITH RECURSIVE e AS (SELECT event_type, event_id, length(event_id || ',' || user_id || ',' || event_type || ',' || coalesce(props, '')) AS len FROM events),
z AS (SELECT event_type, greatest(5120.0, avg(len) * 100) AS size FROM e GROUP BY event_type),
s AS MATERIALIZED (SELECT event_type, event_id, len, row_number() OVER w AS rn, sum(len) OVER w AS upto FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
c AS (SELECT event_type, 0::BIGINT AS chunk, 1::BIGINT AS first, 0::HUGEINT AS base FROM z
  UNION ALL SELECT c.event_type, c.chunk + 1, n.rn + 1, n.upto FROM c JOIN z USING (event_type), LATERAL (SELECT rn, upto FROM s WHERE s.event_type = c.event_type AND s.upto >= c.base + z.size ORDER BY rn LIMIT 1) n)
SELECT s.event_type, event_id, chunk FROM s ASOF JOIN c ON s.event_type = c.event_type AND s.rn >= c.first""")
def row_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables in runs of a least size; the events of each type stand for a file."""
    rows = load(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "props")
    line = F.concat(F.col("event_id").cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit(","), "event_type", F.lit(","), F.coalesce("props", F.lit("")))
    return chunkers.sized_row_groups(rows, "event_type", "event_id", F.length(line), 100).select("event_type", "event_id", "chunk")


@query("""WITH g AS (SELECT user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN d > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in sessions that end after six silent hours."""
    return chunkers.gap_sessions(load(spark, sf_dir, "events"), 21_600)


_WORDS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word, unnest(list_append(w[2:], '')) AS nxt FROM w WHERE len(w) > 0),
y AS (SELECT doc_id, pos, word, regexp_matches(nxt, '^\p{Ll}') AS low, lower(rtrim(word, '.')) AS name FROM x),
ab AS (SELECT name FROM y WHERE regexp_matches(word, '^\p{L}{1,5}\.?$') GROUP BY name HAVING count(*) FILTER (WHERE ends_with(word, '.')) > 1 AND count(*) FILTER (WHERE ends_with(word, '.')) * 100 >= count(*) * 80
  AND count(*) FILTER (WHERE ends_with(word, '.') AND low) * 100 >= count(*) FILTER (WHERE ends_with(word, '.')) * 20),
cut AS (SELECT doc_id, pos FROM y WHERE regexp_matches(word, '[.!?]["'')\]]*$') AND NOT low AND NOT (regexp_matches(word, '^\p{L}+\.$') AND name IN (SELECT name FROM ab))
  UNION SELECT doc_id, len(w) - 1 FROM w WHERE len(w) > 0),
s AS (SELECT y.doc_id, y.pos, word, coalesce(sum(CASE WHEN cut.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY y.doc_id ORDER BY y.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence
  FROM y LEFT JOIN cut ON cut.doc_id = y.doc_id AND cut.pos = y.pos)"""


@query(f"""WITH {_WORDS} SELECT doc_id, sentence // 3 AS "window", count(DISTINCT sentence) AS sentences, string_agg(word, ' ' ORDER BY pos) AS text FROM s GROUP BY ALL""")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three sentences of whole texts."""
    return sentences.windows(tables.docs(spark, sf_dir), 3)
