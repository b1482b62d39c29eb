"""A corpus pipeline of five stages: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the columns of
``docs``. Stages write intermediate tables to the shared scratch folder; a stage deletes those of the one before, whose
result has been written by then.

Rejected: documents without letters or without a likely language; lines that occurred before, and documents made of
nothing else; all but one document of a near-duplicate class; documents with a benchmark passage. Null texts go with the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packlens.llm import decontaminate, language_id, line_dedup, order_minhash, packing
from packlens.session import delete_scratch, recorded, scratch_path

ORACLE_SQL = None  # language models, edit joins and packing have no SQL form; tests/llm compare with brute force

#: Rows that tasks hand to Python at a time. Batches are counted in rows and documents may be long: the default of 10,000 is tens of megabytes at each end.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_leftover: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        delete_scratch(spark, _leftover)
        _leftover.clear()
        with recorded() as paths:
            out = work(spark, docs, sf_dir)
        _leftover.extend(paths)
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.drop_near_duplicates(docs)


@_stage
def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over ``documents``; each result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
