"""The corpus pipeline: language ID, line dedup, near-duplicate removal, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but the last
return the columns of documents, n_chars counting the text as it then is; null texts stay null until packing,
where they have no words. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import langid, line_dedup, minhash_dedup, packing, pii
from fathom.llm.common import written

#: Below this mean probability no learned language fits.
LEAST_SCORE = 0.3
#: Similarity from which documents are near duplicates, in hundredths.
NEAR_PERCENT = 80


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or of no learned language; the prediction fills in null languages.

    Where no language could be learned, only documents without letters go.
    """
    columns, model = docs.columns, langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    hidden = {}  # columns of the input that are named as the prediction's
    for c in ("lang_pred", "score"):
        if c in columns:
            hidden[c] = c + "_"
            while hidden[c] in columns:
                hidden[c] += "_"
    tagged = langid.predict(docs.withColumnsRenamed(hidden), model)
    kept = tagged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in hidden.items()}).select(columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each group of similar lines."""
    return _counted(line_dedup.dedup(docs)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates; documents without words stay."""
    drops = minhash_dedup.dedup(docs, NEAR_PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(drops, "doc_id", "left_anti").select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds."""
    return _counted(pii.redact(spark, docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence."""
    return packing.best_fit(docs)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_duplicates), ("pii", redact_pii), ("packing", pack)]

#: Forward-backward, sketches and best-fit are not expressible in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a data directory; each result is a table for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, _ = written(docs)
    return docs
