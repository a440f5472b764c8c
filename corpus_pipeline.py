"""From raw documents to training sequences: each stage takes and gives documents, the last gives pieces of sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.llm import chunk_dedup, resampling
from jobtide.llm.common import documents
from jobtide.llm.near_duplicates import without_copies
from jobtide.llm.quality_rules import judged
from jobtide.llm.queries import packed
from jobtide.llm.spans import carried
from jobtide.sources.shared import clear_written, put_aside, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return docs.where(judged(F.col("text"))["kept"])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good ones keeps."""
    model = resampling.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return resampling.decided(docs, model).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the lowest id: five words, similarity of 0.8 or more; 96 bands miss a pair of 0.8
    with probability 2e-8."""
    return without_copies(docs, similarity=80, bands=96)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; n_chars is that of the new text, a null text stays null."""
    kept = chunk_dedup.dedup(docs, carry=True)
    text = F.when(~F.col("carried.no_text"), F.col("kept").cast("string"))
    return kept.select(*carried(docs, "text", text)).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: No stage but the first could be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages make of the documents; what a stage keeps is written before the next one reads it, and what it no longer needs goes."""
    docs, mark = documents(spark, sf_dir), put_aside(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear_written(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
