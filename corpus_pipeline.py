"""A corpus pipeline of five stages over `documents`; each stage is written as Parquet and read again by the next.

Language ID drops documents without a language; of each group of near copies the one with the
smallest id stays, rows with equal ids and without one being told apart by their texts; secrets are blanked out; sources are mixed to target weights, whereby a
document can go or occur twice; what is left is encoded, decoded and digested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import bpe, jaccard, langid, mixing, secrets
from loomfield.llm.common import Workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects `und`: null texts and texts without a letter. lang becomes the predicted language. Without labelled rows nothing can be told, and only texts without a letter go."""
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs.select(F.struct("*").alias("row"), "text"), model, keep=["row"]).where("lang_pred <> 'und'")
    return found.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: the smallest by id (null last), digest of the text, and all columns. A text without words is a component for each id."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    found = jaccard.similar_components(docs.select(row.alias("__row"), "text"), key="__row")
    kept = found.where("__row = component_id").select("__row").distinct()
    rows = docs.groupBy(row.alias("__row")).agg(F.min(F.struct(*docs.columns)).alias("__all"))
    return rows.join(kept, "__row", "left_semi").select("__all.*")


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a mark; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it was taken, at most twice."""
    return mixing.repeat(mixing.mix(docs)).select(docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_copies),
    ("secrets", blank_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]
#: SQL can't express the models, the hashes that sampling uses, or BPE; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
