"""Corpus pipeline: quality, near-duplicates, contamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), where ``docs`` has the columns of documents,
and returns a DataFrame; all but the last return those columns.  Every stage decides for
each row by its own text: rows may lack a doc_id or share it with other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roleloom.llm import bpe, decontaminate as decon, near_dup, pii, quality as q, queries
from roleloom.llm._work import bucketed, read, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TEXT_KEY = "struct<n:int,h1:bigint,h2:bigint>"

c = F.col


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled documents among them that are not held out."""
    model = queries.quality_model(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return q.score(docs.select(COLUMNS), model).where(F.col("quality_score") >= queries.QUALITY_THRESHOLD).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id; five words and a similarity of 0.8.

    Every row is a document of its own: rows with one doc_id, or without any, are compared with each other like all others.  Of a group the row with the smallest
    doc_id stays (a null before all), of those the shortest text, then that with the least hash.  Texts without words are in no group, but of rows
    that repeat both doc_id and text one stays.
    """
    # Written, so that the numbers stay, and bucketed by them: texts are shuffled once, later joins move the numbers only.
    rows = bucketed(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "_row")
    found = near_dup.groups(rows.select(c("_row").alias("id"), "text")).select(c("doc_id").alias("_row"), "n_shingles", "component_id")
    text = F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    group = F.when(c("n_shingles") > 0, F.struct(c("component_id").alias("g"), F.lit(None).cast("long").alias("i"), F.lit(None).cast(TEXT_KEY).alias("t"))).otherwise(F.struct(F.lit(None).cast("long").alias("g"), c("doc_id").alias("i"), c("t")))
    ranked = rows.select("_row", "doc_id", text.alias("t"), "lang", "source", "n_chars").join(found, "_row").select(group.alias("group"), F.struct("doc_id", "t", "lang", "source", "n_chars", "_row").alias("r"))
    stays = table(ranked.groupBy("group").agg(F.min("r").alias("r")).select("r._row"))
    return rows.join(stays, "_row", "left_semi").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by a benchmark item, whatever other rows share their doc_id or lack one too."""
    keys = {"_n": F.octet_length("text"), "_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(7), "text")}
    judged = decon.decontaminate(docs.withColumns(keys), read(spark, sf_dir, "benchmark"), carry=tuple(keys))
    # The keys are written first: their size then tells Spark whether to send them to all executors or to shuffle.
    gone = table(judged.where("contaminated").select(c("doc_id").alias("_i"), *keys).distinct())
    same = c("doc_id").eqNullSafe(c("_i"))
    for k, v in keys.items():
        same = same & (v == gone[k])
    return docs.select(COLUMNS).join(gone, same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal data."""
    out = pii.pseudonymize(docs.select(COLUMNS), queries.PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode(docs, *queries.rank_file())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]

#: The classifier, the pseudonyms and the encoder are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else table(out)
    return docs
