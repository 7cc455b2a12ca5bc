"""Queries of document structure: outlines, tables, nested JSON, Markdown, paragraphs, layout, parse errors, chunk files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions import vectors as V
from fathom.operators import chunkers, html_tree, pages
from fathom.plans import tables
from fathom.plans.registry import query
from fathom.session import load
from fathom.sources import chunks, ingest
from fathom.sources.store import shared_folder

_NOISE = r"'(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->'"
_STRUCTURE = r"'(?is)<(/?)(h[1-6]|p|li|div|table|tr|td|th|ul|ol|nav|article|body|head|html|title)(?:\s[^>]*)?>'"
_OUTLINE = rf"""m AS (SELECT page_id, regexp_replace(regexp_replace(html, {_NOISE}, '', 'g'), {_STRUCTURE}, chr(1) || '\1\2' || chr(2), 'g') AS h FROM pages),
e AS (SELECT page_id, generate_subscripts(string_split(h, chr(1)), 1) - 1 AS pos, unnest(string_split(h, chr(1))) AS piece FROM m),
b AS (SELECT page_id, pos, CASE WHEN NOT contains(piece, chr(2)) OR starts_with(piece, '/') THEN 'body' ELSE lower(split_part(piece, chr(2), 1)) END AS tag,
  trim(regexp_replace(regexp_replace(CASE WHEN contains(piece, chr(2)) THEN split_part(piece, chr(2), 2) ELSE piece END, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM e),
l AS (SELECT *, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(substr(tag, 2, 1) AS INTEGER) ELSE 7 END AS level FROM b WHERE text <> '')"""


@query(f"WITH {_OUTLINE} SELECT page_id, pos, tag, text, (SELECT max(a.pos) FROM l a WHERE a.page_id = l.page_id AND a.pos < l.pos AND a.level < l.level) AS parent FROM l")
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of web pages under their headings, divisions and cells included."""
    return chunkers.html_outline(load(spark, sf_dir, "pages"))


_VOID = ", ".join(f"'{v}'" for v in html_tree.VOID)
_TAG = html_tree.TAG.replace("'", "''")
_TREE = rf"""m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, {_NOISE}, '', 'g'), '{html_tree.DECLARATION}', '', 'g'), '{_TAG}', chr(1) || '\1\2' || chr(2), 'g') AS h FROM pages),
e AS (SELECT page_id, generate_subscripts(string_split(h, chr(1)), 1) - 1 AS pos, unnest(string_split(h, chr(1))) AS piece FROM m),
t AS (SELECT page_id, pos, ltrim(lower(split_part(piece, chr(2), 1)), '/') AS name, starts_with(piece, '/') AS shut, trim(regexp_replace(split_part(piece, chr(2), 2), '\s+', ' ', 'g')) AS text FROM e WHERE pos > 0),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY pos) AS r FROM t WHERE name NOT IN ({_VOID})),
f AS (SELECT page_id, name, r, pos, CASE WHEN shut THEN [] ELSE [pos] END AS open, NULL::BIGINT AS closes FROM s WHERE r = 1
  UNION ALL SELECT s.page_id, s.name, s.r, s.pos, CASE WHEN s.shut THEN f.open[:len(f.open) - 1] ELSE list_append(f.open, s.pos) END, CASE WHEN s.shut THEN f.open[len(f.open)] END FROM f JOIN s ON s.page_id = f.page_id AND s.name = f.name AND s.r = f.r + 1),
p AS (SELECT page_id, pos FROM f WHERE closes IS NOT NULL UNION SELECT page_id, closes FROM f WHERE closes IS NOT NULL),
o AS (SELECT t.*, p.pos IS NOT NULL AS pair, row_number() OVER (PARTITION BY t.page_id ORDER BY t.pos) AS r FROM t LEFT JOIN p ON p.page_id = t.page_id AND p.pos = t.pos),
g AS (SELECT page_id, r, []::BIGINT[] AS before, CASE WHEN pair AND NOT shut THEN [pos] ELSE [] END AS stack FROM o WHERE r = 1
  UNION ALL SELECT o.page_id, o.r, g.stack, CASE WHEN o.pair AND o.shut THEN g.stack[:len(g.stack) - 1] WHEN o.pair THEN list_append(g.stack, o.pos) ELSE g.stack END FROM g JOIN o ON o.page_id = g.page_id AND o.r = g.r + 1)"""


@query(f"WITH RECURSIVE {_TREE} SELECT page_id, pos, name, len(before) AS depth, before[len(before)] AS parent, pair AS closed, text FROM o JOIN g USING (page_id, r) WHERE NOT shut")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of the pages with its depth and the element around it; the SQL folds the tags with a stack."""
    return html_tree.tree(load(spark, sf_dir, "pages"))


_ROWS = r"'(?is)<tr(?:\s[^>]*)?>(.*?)</tr>'"
_CELLS = r"'(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>'"


@query(rf"""WITH h AS (SELECT page_id, '<body><TABLE border=1><tr class="h"><th>url</th>' || chr(10) || '<td> ' || url || ' </td></tr><TR><td>' || html || '</td></TR></TABLE><table></table>' AS h FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<table(?:\s[^>]*)?>(.*?)</table>', 1)) AS t, generate_subscripts(regexp_extract_all(h, '(?is)<table(?:\s[^>]*)?>(.*?)</table>', 1), 1) - 1 AS tbl FROM h),
r AS (SELECT page_id, tbl, unnest(regexp_extract_all(t, {_ROWS}, 1)) AS r, generate_subscripts(regexp_extract_all(t, {_ROWS}, 1), 1) - 1 AS "row" FROM t)
SELECT page_id, tbl, "row", '| ' || array_to_string(list_transform(regexp_extract_all(r, {_CELLS}, 1), lambda c: trim(regexp_replace(regexp_replace(c, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), ' | ') || ' |' AS markdown FROM r""")
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables in pages; the given pages have no tables, so each becomes a cell of one, markup and all."""
    html = F.concat(F.lit('<body><TABLE border=1><tr class="h"><th>url</th>\n<td> '), "url", F.lit(" </td></tr><TR><td>"), "html", F.lit("</td></TR></TABLE><table></table>"))
    return chunkers.html_table_rows(load(spark, sf_dir, "pages").select("page_id", html.alias("html")))


@query("""SELECT event_id, path, value FROM (SELECT event_id, 'at[0]' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 'at[1].user', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'props.k', json_extract_string(props, '$.k') FROM events WHERE props IS NOT NULL)""")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of nested JSON; each event is written as an object with an array and an object within first."""
    made = F.concat(F.lit('{"at": ["'), "event_type", F.lit('", {"user": '), F.col("user_id").cast("string"), F.lit('}], "props": '), F.coalesce("props", F.lit("{}")), F.lit("}"))
    return chunkers.json_paths(load(spark, sf_dir, "events").select("event_id", made.alias("j")), "event_id", "j")


@query(r"""WITH m AS (SELECT conv_id, string_agg('## ' || role || chr(10) || text || chr(10) || '```' || chr(10) || turn || chr(10) || chr(10) || '# no' || chr(10) || '```' || chr(10), chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM m),
f AS (SELECT *, starts_with(line, '```') AS fence, count(*) FILTER (WHERE starts_with(line, '```')) OVER (PARTITION BY conv_id ORDER BY pos) AS fences FROM l),
k AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM f),
b AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM k),
n AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR kind <> before OR kind = 'heading' OR (kind = 'code' AND fence AND fences % 2 = 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS block FROM b)
SELECT conv_id, block, kind, string_agg(line, chr(10) ORDER BY pos) AS text FROM n WHERE kind <> 'blank' GROUP BY ALL""")
def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and fenced code of Markdown; each conversation, with all lines of its turns, is written as such a document first."""
    one = F.concat(F.lit("## "), "role", F.lit("\n"), "text", F.lit("\n```\n"), F.col("turn").cast("string"), F.lit("\n\n# no\n```\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text", one.alias("t"))))
    made = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("o")).select("conv_id", F.array_join("o.t", "\n").alias("text"))
    return chunkers.markdown_blocks(made, "conv_id")


@query(r"""WITH c AS (SELECT conv_id, string_agg(text, chr(10) || ' ' || chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n\s*'), lambda x: trim(x)), lambda x: x <> '') AS p FROM c WHERE text IS NOT NULL)
SELECT conv_id, generate_subscripts(p, 1) - 1 AS para, unnest(p) AS text FROM p""")
def plain_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs between blank lines; each conversation, with all lines of its turns, is written as a plain text first."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return chunkers.paragraphs(load(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(ordered.alias("o")).select("conv_id", F.array_join("o.text", "\n \n\n").alias("text")), "conv_id")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, pos // 5 AS para, string_agg(line, chr(10) ORDER BY pos) AS text FROM l GROUP BY ALL""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five lines of texts without blank lines."""
    return chunkers.paragraphs(tables.docs(spark, sf_dir), lines=5)


@query("SELECT l_orderkey AS page, (l_linenumber // 3)::DOUBLE AS top, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_quantity, l_returnflag || l_linenumber) AS line FROM lineitem GROUP BY ALL")
def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from placed words; line items stand for the words of a page."""
    text = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    top = F.floor(F.col("l_linenumber") / 3).cast("double")
    return pages.words_to_lines(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (top + 0.04).alias("top"), F.col("l_quantity").alias("x0"), text.alias("text")))


@query("""SELECT l_orderkey AS page, string_agg(l_returnflag || l_linenumber, chr(10) ORDER BY CASE WHEN l_linenumber % 3 = 2 THEN 0 ELSE l_quantity END, l_linenumber % 3, l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY ALL""")
def merge_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, images and tables of a page in reading order; line items stand for them."""
    kind = F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("table")), F.col("l_linenumber") % 3 + 1)
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), kind.alias("kind"), F.col("l_quantity").alias("top"), F.col("l_linenumber").alias("idx"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return pages.merge_layout(rows)


@query("""SELECT p_partkey, CAST(trunc(p_size * 1700.0::DOUBLE / 612.0::DOUBLE) AS INTEGER) AS w, CAST(trunc(p_retailprice * 17.0::DOUBLE / 612.0::DOUBLE) AS INTEGER) AS h,
trunc(p_size * 1700.0::DOUBLE / 612.0::DOUBLE) >= 50 AND trunc(p_retailprice * 17.0::DOUBLE / 612.0::DOUBLE) >= 50 AS large FROM part""")
def image_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page coordinates in pixels, and which images are large enough to be read; parts stand for images."""
    px = lambda c, n: T.scale_pixels(F.col(c), F.lit(n), F.lit(612.0))
    sized = load(spark, sf_dir, "part").select("p_partkey", px("p_size", 1700.0).alias("w"), px("p_retailprice", 17.0).alias("h"))
    return sized.withColumn("large", T.image_large_enough(F.col("w"), F.col("h")))


@query(r"SELECT doc_id, NOT (text IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 20 AND regexp_matches(text, '\p{L}')) AS auto, true AS forced, false AS disabled FROM documents")
def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents would have to be read from an image, by setting."""
    text = F.col("text")
    return tables.docs(spark, sf_dir).select("doc_id", T.needs_ocr(text).alias("auto"), T.needs_ocr(text, force=True).alias("forced"), T.needs_ocr(text, force=True, disable=True).alias("disabled"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp, CASE WHEN event_id - 5 <= 0 OR event_id * 1000 > 1000000 THEN 8192 ELSE event_id * 1000 END AS limit_tokens FROM events WHERE event_id - 5 <= 0 OR event_id > 0")
def stamps_and_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps with a Z, and tokenizer limits of which some mean none."""
    asked = F.when(F.col("event_id") - 5 <= 0, F.col("event_id") - 5).otherwise(F.col("event_id") * 1000)
    return load(spark, sf_dir, "events").select("event_id", T.utc_stamp(F.col("ts")).alias("stamp"), T.tokenizer_limit(asked).alias("limit_tokens"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM conversations)
SELECT conv_id, turn, len(t[1:1 + turn * 4]) AS n, len(t) > 1 + turn * 4 AS cut, array_to_string(t[1:1 + turn * 4], ' ') AS text FROM t""")
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text cut to its own limit of tokens."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t"), (F.lit(1) + F.col("turn") * 4).cast("int").alias("limit"))
    kept = rows.select("conv_id", "turn", "t", "limit", T.truncate(F.col("t"), F.col("limit")).alias("k"))
    return kept.select("conv_id", "turn", F.size("k").cast("long").alias("n"), (F.size("t") > F.col("limit")).alias("cut"), F.array_join("k", " ").alias("text"))


@query("""SELECT vec_id, CAST(d AS BIGINT) AS dim, round((embedding[d + 1]::DOUBLE + embedding[d + 17]::DOUBLE + (vec_id % 2) * embedding[d + 33]::DOUBLE) / (2 + vec_id % 2), 6) AS mean FROM embeddings, range(16) r(d)""")
def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the token axis by a mask; four parts of each vector stand for its tokens."""
    hidden = F.array(*(F.slice("embedding", 16 * i + 1, 16) for i in range(4)))
    mask = F.array(F.lit(1), F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(0))
    each = tables.vectors(spark, sf_dir).select("vec_id", F.posexplode(V.masked_mean(hidden, mask, 16)).alias("dim", "mean"))
    return each.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("SELECT event_id % 7 = 0 AS failed, CASE WHEN event_id % 7 = 0 THEN 'ValueError' END AS error, count(*) AS n, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id END) AS BIGINT) AS total FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser that fails on some objects: errors are a column, results of the others are kept."""
    raw = load(spark, sf_dir, "events").where("user_id is not null").select(F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("user_id").cast("string")).alias("content"))
    parsed = ingest.with_errors(raw, lambda x: [{"n": int(x)}], "n: bigint")
    return parsed.groupBy(F.col("error").isNotNull().alias("failed"), F.split("error", ":")[0].alias("error")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.get("result", F.lit(0))["n"]), F.lit(0)).alias("total"))


@query("SELECT md5(text) || '_1' AS chunk_id, md5(text) AS document_id, length(text) AS chars, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as JSON lines and read back under the format's schema."""
    folder = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    made = tables.docs(spark, sf_dir).where("text is not null").select(F.concat(F.md5("text"), F.lit("_1")).alias("chunk_id"), F.md5("text").alias("document_id"), "text")
    chunks.write_chunks(made, folder, "json")
    return chunks.read_chunks(spark, folder, lines=True).groupBy("chunk_id", "document_id", F.length("text").cast("long").alias("chars")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, raw_key, CASE WHEN q THEN md5(text) ELSE '' END AS document_id, CASE WHEN q AND ext = 'pdf' THEN 'application/pdf' WHEN q THEN m ELSE 'application/octet-stream' END AS mime_type, q AS accepted FROM (
SELECT doc_id, raw_key, text, ext, doc_id IN (SELECT doc_id FROM labels) AS q, coalesce(MIME, 'application/octet-stream') AS m FROM (SELECT *, list_extract(string_split(raw_key, '.'), -1) AS ext FROM (
SELECT doc_id, text, 'data/raw/' || source || '/' || doc_id || '.' || EXTS[doc_id % NEXT + 1] AS raw_key FROM documents WHERE text IS NOT NULL)))""".replace("EXTS", str(list(tables.EXTENSIONS))).replace("NEXT", str(len(tables.EXTENSIONS))).replace("MIME", "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ingest.MEDIA_TYPES.items()) + " END"))
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with their manifests; those without one get defaults and are not accepted. Labelled documents have one."""
    raw = tables.raw_objects(spark, sf_dir)
    known = ingest.manifests(raw.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), "run-0")
    return ingest.with_manifest(raw.select("doc_id", "raw_key"), known)
