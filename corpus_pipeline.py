"""From raw documents to packed training sequences in five stages, each written as Parquet for the next.

A stage takes (spark, docs, sf_dir), with docs read from files, and returns the documents it keeps, with the columns of
``documents``; the last returns the packed pieces. Rows are told apart by their place, so missing and repeated keys are
treated like any others. Null and empty texts have no language and go in the first stage; texts of any length are
treated whole; further columns of the input are left out, whatever their names; an empty table passes every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import numbered, scratch, shared_folder
from marlstone.llm.op2_jaccard_join import similar_classes
from marlstone.llm.op3_decontaminate import contamination
from marlstone.llm.op6_language import classify, fit
from marlstone.llm.op8_packing import pack
from marlstone.llm.op10_pii import find_spans, redact

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Below this a language is taken as unknown.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised."""
    judged = classify(docs, fit(docs), keep=COLUMNS)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    spare = similar_classes(docs, fixed=True).where("NOT is_first").select("_row").hint("shuffle_hash")
    return numbered(docs, fixed=True).join(spare, "_row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = contamination(docs, benchmark, fixed=True).where("contaminated").select("_row").hint("shuffle_hash")
    return numbered(docs, fixed=True).join(hit, "_row", "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    found = find_spans(docs, keep=COLUMNS)
    body = F.when(F.col("text").isNotNull(), redact(F.col("text"), F.col("spans")))
    return found.withColumn("text", body).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into windows of token ids."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Language, PII and packing learn or pack outside SQL; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
