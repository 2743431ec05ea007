"""The corpus pipeline: toxic documents go, repeated lines go, one of near-duplicates stays, contaminated documents go, sources are mixed.

Every stage works on all that the one before it kept. All but the last return the columns of `documents`; the last adds `n_copies`, the
times that the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stallbook.llm import decontamination, line_dedup, mixing, ngram_join, toxicity
from stallbook.llm.queries import may_learn
from stallbook.llm.tokens import small_batches
from stallbook.scratch import stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The model learns from the labels that op5 learns from."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, may_learn(spark, sf_dir, 4, 2))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    small_batches(spark)
    return line_dedup.drop_repeated_lines(docs)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more connect, the smallest doc_id stays."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies."""
    return mixing.mixed_documents(docs)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", similar), ("benchmark decontamination", benchmark), ("mixing", mix)]

#: The first stage is a learned model and the last one rounds its rates by a rule of its own; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
