"""Training-corpus pipeline: each stage works on all documents that the one before it kept.

Quality rules drop documents, near duplicates leave one document of each component,
repeated passages and benchmark passages are cut from texts (documents mostly made of
benchmark text go), and what remains is packed into fixed windows of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm.decontamination import decontaminate
from cellgrid.llm.neardup import keep_one
from cellgrid.llm.packing import pack
from cellgrid.llm.quality import keep_good
from cellgrid.llm.queries import tokenizer_path
from cellgrid.llm.store import drop_table, temporary, write_table
from cellgrid.llm.substrings import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: without the documents that the rules reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, on shingles of five words: of each component the document with the smallest id."""
    return keep_one(docs, size=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: texts without the words of repeated windows."""
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: texts without benchmark passages, and without the documents that these make up."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the remaining documents as pieces of fixed windows of tokens."""
    return pack(docs, tokenizer_path(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Models, similarity classes and tokens have no SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written and read again, and all else that it wrote is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with temporary() as keep:
            docs = keep(write_table(stage(spark, docs, sf_dir), name.replace(" ", "_")))
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
