"""A training corpus from ``documents``: good ones, once each, without the benchmark, packed.

STAGES are (name, function) in order. A function takes (spark, docs, sf_dir), works on
all rows of docs and returns documents with the same columns, the last one pieces of
packed sequences. run() writes each result as Parquet in the shared folder and
rereads it for the next stage, so a lost executor costs part of one stage.

Rows with null texts count as empty; what a stage does with other odd rows its
operator's docstring says; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import common, decontaminate, exact_dedup, near_dedup, packing, quality, tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return packing.pack(docs, tokens.tokenizer_path(), 1, targets=packing.TEMPER)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: No SQL for MinHash classes, a trained model or a tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents. What a stage has written on its way goes when its result stands."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = common.made()
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        common.clear_shared(spark, before, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
