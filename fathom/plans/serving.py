"""Queries of access control, quotas, batching and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import serving
from fathom.plans.registry import query
from fathom.session import load
from fathom.sources.store import shared_folder
from fathom.streaming import streams

LIMIT, DAY = 3, 86_400

_FOLD = """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, ts, event_id, r, ts AS anchor, 1::BIGINT AS used, 0::BIGINT AS number FROM e WHERE r = 1
UNION ALL SELECT e.user_id, e.ts, e.event_id, e.r, CASE WHEN e.ts >= f.anchor + INTERVAL {0} THEN e.ts ELSE f.anchor END, CASE WHEN e.ts >= f.anchor + INTERVAL {0} THEN 1 ELSE f.used + 1 END, CASE WHEN e.ts >= f.anchor + INTERVAL {0} THEN f.number + 1 ELSE f.number END
FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)"""
_ONE_DAY = _FOLD.format("1 DAY")


@query("""WITH m AS (SELECT user_id, event_id, 'u' || user_id || '@' || CASE event_id % 4 WHEN 0 THEN 'example.com' WHEN 1 THEN 'Example.com' WHEN 2 THEN 'sub.example.com' ELSE 'example.org' END AS email FROM events)
SELECT event_id, email, ends_with(email, '@example.com') OR ends_with(email, '@example.org') AS allowed FROM m""")
def domain_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of allowed domains."""
    host = F.expr("CASE event_id % 4 WHEN 0 THEN 'example.com' WHEN 1 THEN 'Example.com' WHEN 2 THEN 'sub.example.com' ELSE 'example.org' END")
    mails = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@"), host).alias("email"))
    return mails.withColumn("allowed", serving.domain_allowed(F.col("email"), ("example.com", "example.org")))


@query("SELECT event_id, 's' || user_id AS sub, 'u' || event_id || '@example.com' AS email FROM events")
def jwt_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims read back from tokens in the URL-safe alphabet without padding."""
    body = F.to_json(F.struct(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sub"), F.concat(F.lit("u"), F.col("event_id").cast("string"), F.lit("@example.com")).alias("email")))
    token = F.concat(F.lit("e30."), F.regexp_replace(F.translate(F.base64(F.encode(body, "UTF-8")), "+/", "-_"), r"[=\r\n]", ""), F.lit(".x"))
    return load(spark, sf_dir, "events").select("event_id", serving.jwt_claims(token).alias("c")).select("event_id", "c.sub", "c.email")


@query(f"{_ONE_DAY} SELECT event_id, user_id, used, number, used <= {LIMIT} AS allowed FROM f")
def quota_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls are within a quota that starts anew a day after its first call."""
    return serving.anchored_windows(load(spark, sf_dir, "events"), DAY, LIMIT).select("event_id", "user_id", "used", "number", "allowed")


@query(f"{_ONE_DAY} SELECT CASE WHEN used <= {LIMIT} THEN 'LLM' ELSE 'NoLLM' END AS mode, count(*) AS n FROM f GROUP BY 1")
def llm_mode_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls each kind of answer gets."""
    calls = serving.anchored_windows(load(spark, sf_dir, "events"), DAY, LIMIT)
    return calls.groupBy(serving.answer_mode(F.col("allowed")).alias("mode")).agg(F.count("*").alias("n"))


@query(f"{_FOLD.format('30 MINUTE')} SELECT user_id, number, count(*) AS n, max(used) AS batch_max FROM f GROUP BY user_id, number")
def microbatch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in batches that close a fixed time after their first one."""
    calls = serving.anchored_windows(load(spark, sf_dir, "events"), 1800, LIMIT)
    return calls.groupBy("user_id", "number").agg(F.count("*").alias("n"), F.max("used").alias("batch_max"))


@query("SELECT conv_id AS request_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS texts_md5 FROM conversations GROUP BY conv_id")
def batch_reslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts handled one by one and gathered again by request."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    requests = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("o")).select(F.col("conv_id").alias("request_id"), F.col("o.text").alias("texts"))
    return serving.batch_slices(requests).select("request_id", "n", F.md5(F.array_join("texts", "\n")).alias("texts_md5"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts, as a batch."""
    return streams.window_counts(streams.timed(load(spark, sf_dir, "events")))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream over the files, read once its input is used up."""
    return streams.run_once(spark, sf_dir, "events", lambda e: streams.window_counts(streams.timed(e)), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind of a user, by a stream with state."""
    return streams.run_once(spark, sf_dir, "events", lambda e: e.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")


@query("SELECT DISTINCT md5(text) AS file_hash FROM documents WHERE text IS NOT NULL")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental ingest: each content once, by a stream over the files."""
    return streams.run_once(spark, sf_dir, "documents", streams.first_of_content, "append")


@query(f"{_ONE_DAY} SELECT event_id, user_id, used, used <= {LIMIT} AS allowed FROM f")
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quota as a stream: calls wait in a user's state until the watermark has passed them."""
    return streams.run_once(spark, sf_dir, "events", lambda e: streams.quota(e, DAY, LIMIT), "append", close="ts")


@query(f"{_FOLD.format('30 MINUTE')} SELECT user_id, number, count(*) AS n, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS events FROM f GROUP BY user_id, number")
def stream_microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in batches that a timer flushes half an hour after their first one, as a stream."""
    found = streams.run_once(spark, sf_dir, "events", lambda e: streams.micro_batches(e, 1800), "append", close="ts")
    return found.select("user_id", "number", "n", F.array_join(F.col("events").cast("array<string>"), ",").alias("events"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each conversation, kept by a stream whose batches can be run again without harm."""
    base = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")
    sink = streams.upsert_sink(f"{base}/table", "conv_id", "turn")
    rows.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return streams.upserted(spark, f"{base}/table", "conv_id", "turn").select("conv_id", "turn", "role", "text")
