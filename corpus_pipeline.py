"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Every stage works on all that the one before kept. All but the last return the columns of
documents; the last returns the packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import line_dedup, ngram_join, packing, quality_rules, source_mixing
from canvass.llm.storage import fresh, written


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or whose quality posterior is too low go."""
    kept = fresh([*docs.columns, *quality_rules.BASE, "base_failed", "quality"], "kept")
    judged = quality_rules.apply_rules(docs)
    return judged.where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but one."""
    return line_dedup.dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def _ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: five-word shingles, 0.8."""
    return ngram_join.keep_one(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their rates say."""
    return source_mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", _quality_rules),
    ("line dedup", _line_dedup),
    ("n-gram Jaccard join", _ngram_join),
    ("mixing sources to target weights", _mixing),
    ("best-fit packing", _packing),
]

#: Trained rules, tokenizers and the fit of rates have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
