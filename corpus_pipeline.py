"""Corpus pipeline: the stages that turn raw documents into encoded training text.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs. Each stage works on
all that the one before kept, and its decisions take effect: rejected documents go, duplicate
lines are cut out, one document of each near-duplicate group stays, contaminated documents go.
All stages but the last return the columns of ``documents``; ``n_chars`` stays that of the
document as it was collected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logsmith.llm.bpe import with_bpe
from logsmith.llm.common import shipped, staged, table
from logsmith.llm.decontam import find_contamination
from logsmith.llm.line_dedup import dedup_lines
from logsmith.llm.quality import judge
from logsmith.llm.simhash import representatives


@shipped
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return judge(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


@shipped
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line repeats."""
    return dedup_lines(docs).select(docs.columns)


@shipped
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each SimHash group."""
    return representatives(docs).select(docs.columns)


@shipped
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(docs.columns)


@shipped
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and the text they decode to."""
    return with_bpe(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_text"
    )


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The forest and the fingerprints have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written into the shared folder and
    read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
