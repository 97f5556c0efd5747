"""Cleaning pipeline over the documents table: five training-data operators, one after another.

Every stage but the last returns the columns of documents; each works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dimtrail.llm import decontaminate, line_templates, pieces, quality, simhash
from dimtrail.llm.common import checkpointed, documents
from dimtrail.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null, empty and blank texts go, repeated rows are judged alike. An empty table stays empty, here and in every stage."""
    return quality.with_quality(docs).where("keep").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates; null and empty texts as they are."""
    return line_templates.with_line_drops(docs).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, nulls last; texts without words are one group, repeated rows one row."""
    return simhash.keep_one(docs).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark contaminates; null and empty texts stay."""
    return decontaminate.with_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the sampled pieces and their number, none for a null or empty text."""
    from pyspark.sql import functions as F

    return pieces.with_pieces(docs, tokenizer("pieces")).select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("pieces", piece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, with a checkpoint between them."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs


#: Learned weights and sampled pieces are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
