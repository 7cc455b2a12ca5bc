"""Queries of ingestion: routing, hashing, incremental skips, sync, upserts, links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import pages
from fathom.plans import tables
from fathom.plans.registry import query
from fathom.session import load
from fathom.sources import chunks, ingest
from fathom.sources.store import shared_folder

_EXT = "[" + ", ".join(f"'{e}'" for e in tables.EXTENSIONS) + "]"
_RAW = f"raw AS (SELECT doc_id, 'data/raw/' || source || '/' || doc_id || '.' || {_EXT}[doc_id % {len(tables.EXTENSIONS)} + 1] AS raw_key, text FROM documents WHERE text IS NOT NULL)"
_CASE = lambda table: "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
_KEYED = "keyed AS (SELECT *, lower(list_extract(string_split(raw_key, '.'), -1)) AS ext FROM raw)"


@query(f"WITH {_RAW}, {_KEYED} SELECT doc_id, raw_key, ext, {_CASE(ingest.PARSERS)} AS parser FROM keyed")
def route_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes raw objects to parsers by extension."""
    return ingest.route(tables.raw_objects(spark, sf_dir)).select("doc_id", "raw_key", "ext", "parser")


@query(f"WITH {_RAW}, {_KEYED} SELECT doc_id, coalesce({_CASE(ingest.MEDIA_TYPES)}, '{ingest.UNKNOWN_TYPE}') AS mime_type FROM keyed")
def mime_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media types of raw objects."""
    return tables.raw_objects(spark, sf_dir).select("doc_id", ingest.media_type(F.col("raw_key")).alias("mime_type"))


@query(f"WITH {_RAW}, {_KEYED} SELECT md5(text) AS file_hash, raw_key, 'run-0' AS pipeline_run_id, coalesce({_CASE(ingest.MEDIA_TYPES)}, '{ingest.UNKNOWN_TYPE}') AS mime_type FROM keyed")
def content_hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests with content hashes."""
    return ingest.manifests(tables.raw_objects(spark, sf_dir), "run-0")


@query(f"WITH {_RAW} SELECT doc_id, md5(text) AS file_hash FROM raw WHERE md5(text) NOT IN (SELECT md5(text) FROM raw WHERE doc_id IN (SELECT doc_id FROM labels))")
def skip_processed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose content was not processed yet; what labels cover counts as processed."""
    raw = tables.raw_objects(spark, sf_dir).select("doc_id", ingest.content_hash(F.col("content")).alias("file_hash"))
    done = raw.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return ingest.skip_processed(raw, done).select("doc_id", "file_hash")


@query("""WITH here AS (SELECT DISTINCT 'obj/' || doc_id AS rel FROM documents), there AS (SELECT DISTINCT 'obj/' || c_custkey AS rel FROM customer)
SELECT rel, 'local' AS side FROM here WHERE rel NOT IN (SELECT rel FROM there) UNION ALL SELECT rel, 'remote' FROM there WHERE rel NOT IN (SELECT rel FROM here)""")
def sync_diff_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either of two listings lacks; the keys of two tables stand in for a folder and a bucket."""
    listed = lambda table, key: load(spark, sf_dir, table).select(F.concat(F.lit("obj/"), F.col(key).cast("string")).alias("rel"))
    return ingest.sync_difference(listed("documents", "doc_id"), listed("customer", "c_custkey"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key."""
    return ingest.upsert(load(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")]).select("conv_id", "turn", "role", "text")


@query("SELECT md5(text) AS document_id, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that several documents share."""
    docs = tables.docs(spark, sf_dir).where("text is not null")
    return docs.groupBy(F.md5("text").alias("document_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_PAGES = r"""
first AS (SELECT md5(text) AS document_id, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1),
ls AS (SELECT f.document_id, generate_subscripts(string_split(d.text, chr(10)), 1) - 1 AS pos, unnest(string_split(d.text, chr(10))) AS line FROM documents d JOIN first f USING (doc_id)),
paged AS (SELECT document_id, pos // 20 + 1 AS page_number, pos, line FROM ls),
headed AS (SELECT * FROM paged UNION ALL SELECT DISTINCT document_id, page_number, -1, '## Page ' || page_number FROM paged),
stripped AS (SELECT document_id, page_number, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM headed),
good AS (SELECT * FROM stripped WHERE length(line) >= 5 AND length(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g')) * 10 >= length(line) * 6),
uniq AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY document_id, page_number, lower(line) ORDER BY pos) = 1),
pages AS (SELECT p.document_id || '_' || p.page_number AS chunk_id, p.document_id, p.page_number, coalesce(string_agg(u.line, chr(10) || chr(10) ORDER BY u.pos), '') AS text
  FROM (SELECT DISTINCT document_id, page_number FROM paged) p LEFT JOIN uniq u USING (document_id, page_number) GROUP BY ALL),
linked AS (SELECT chunk_id, document_id, page_number, document_id || '_page' || page_number AS parent_id, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM pages WINDOW w AS (PARTITION BY document_id ORDER BY page_number)),
edges AS (SELECT chunk_id AS src, parent_id AS dst, 'parent_id' AS relation FROM linked UNION ALL SELECT chunk_id, previous_id, 'previous_id' FROM linked WHERE previous_id IS NOT NULL UNION ALL SELECT chunk_id, next_id, 'next_id' FROM linked WHERE next_id IS NOT NULL)
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assemble_pages(pages.unique_documents(tables.docs(spark, sf_dir)))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.link_pages(pages.page_numbers(pages.unique_documents(tables.docs(spark, sf_dir))))


@query(f"WITH {_PAGES} SELECT chunk_id, document_id, page_number, text FROM pages")
def page_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page chunks of each distinct document."""
    return _pages(spark, sf_dir)


@query(f"WITH {_PAGES} SELECT page_number, count(*) AS n, count(*) FILTER (WHERE starts_with(text, '## Page ')) AS with_header FROM pages GROUP BY page_number")
def page_header_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks kept their page header: the line rule drops it below page 10."""
    found = _pages(spark, sf_dir)
    return found.groupBy("page_number").agg(F.count("*").alias("n"), F.count_if(F.startswith("text", F.lit("## Page "))).alias("with_header"))


@query(f"WITH {_PAGES} SELECT chunk_id, parent_id, previous_id, next_id FROM linked")
def chunk_links_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and next chunks in page order."""
    return _links(spark, sf_dir).select("chunk_id", *chunks.LINKS)


@query(f"WITH {_PAGES} SELECT src, dst, relation FROM edges")
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural edges of all chunks."""
    return chunks.edges(_links(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT relation, count(*) AS n FROM edges WHERE dst NOT IN (SELECT chunk_id FROM pages) GROUP BY relation")
def dangling_edge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to chunks that do not exist, by relation."""
    linked = _links(spark, sf_dir)
    return chunks.dangling(chunks.edges(linked), linked).groupBy("relation").agg(F.count("*").alias("n"))


@query("SELECT vec_id, embedding IS NOT NULL AND coalesce(len(embedding), 0) = 64 AS ok FROM embeddings")
def embedding_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of the right length."""
    from fathom.functions.vectors import is_valid

    return tables.vectors(spark, sf_dir).select("vec_id", is_valid(F.col("embedding"), 64).alias("ok"))


@query(r"SELECT doc_id, text IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 20 AND regexp_matches(text, '\p{L}') AS valid FROM documents")
def valid_text_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with enough text to need no OCR."""
    return tables.docs(spark, sf_dir).select("doc_id", T.is_valid_text(F.col("text")).alias("valid"))


#: Documents of an object, by id.
PER_OBJECT = 500


@query(f"""SELECT source, doc_id // {PER_OBJECT} AS part, count(*) AS n, sum(strlen(doc_id || ':' || md5(text)) + 1)::BIGINT AS bytes, md5(string_agg(doc_id || ':' || md5(text), chr(10) ORDER BY doc_id) || chr(10)) AS file_hash
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY ALL""")
def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects listed and read back: the documents of each source are written as text objects of a bounded number of lines first."""
    folder = f"{shared_folder(spark)}/objects-{uuid.uuid4().hex}"
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.md5("text"))
    lines = tables.docs(spark, sf_dir).where("text is not null and source is not null").select("source", F.floor(F.col("doc_id") / PER_OBJECT).alias("part"), "doc_id", line.alias("value"))
    lines.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").drop("doc_id").write.partitionBy("source", "part").text(folder)
    found = ingest.list_raw(spark, folder, "*.txt")
    place = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    count = F.size(F.split(F.col("content").cast("string"), "\n", -1)) - 1
    return found.select(place("source").alias("source"), place("part").cast("long").alias("part"), count.cast("long").alias("n"), F.col("length").alias("bytes"), ingest.content_hash(F.col("content")).alias("file_hash"))
