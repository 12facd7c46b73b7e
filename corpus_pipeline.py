"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), docs having the columns of documents, and returns a DataFrame, which is written as Parquet to the
shared folder and read again as the next stage's docs. All stages but the last return the columns of documents.

Defined cases: documents whose text is null or without letters are rejected by the first stage, so later ones don't see them; null ids,
sources and languages stay as they are; rows that repeat id and text are near copies of each other, and one stays; very long texts go
through every stage whole; ties go by id; an empty table gives no pieces; further columns of documents, of any name, are kept up to the
last stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrist.llm import language_id, line_dedup, mixing, near_dedup, packing
from lumengrist.llm.common import boxed, load, unboxed, write_shared
from lumengrist.sources.shared import plain_reads

#: A document is rejected as of no known language below this calibrated probability.
LEAST_SCORE = 0.5


def lean(stage):
    """A stage whose reads of whole texts leave no buffers behind, which all later stages would have beside their own memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain_reads(spark)
        return stage(spark, docs, sf_dir)

    return run


@lean
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: rejected are those without letters and those that no language fits well enough.
    While nothing can be learnt, documents with letters stay."""
    model = language_id.learn_from_documents(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    said = language_id.identify(boxed(docs, text=F.col("text")), model)
    return unboxed(said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


@lean
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


@lean
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


@lean
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@lean
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learnt models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
