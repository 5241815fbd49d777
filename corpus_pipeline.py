"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; ``run`` writes each one's result as Parquet in the shared folder
and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.common import materialize, table
from docketry.llm.compression_rules import compression_rules
from docketry.llm.line_dedup import drop_common_lines
from docketry.llm.near_dedup import drop_near_duplicates
from docketry.llm.packing import pack_documents
from docketry.llm.queries import WEIGHTS, tokenizer_path
from docketry.llm.source_mixing import mix_sources
from docketry.sources.shared import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of words, repeats and compression bands keep."""
    return compression_rules(docs).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten or more share."""
    return drop_common_lines(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    return drop_near_duplicates(docs).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights; one epoch at most, as packing names its pieces by document."""
    return mix_sources(docs, max_epochs=1, weights=WEIGHTS, default_weight=2).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 2048."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Compression ratios, signatures and token ids have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
