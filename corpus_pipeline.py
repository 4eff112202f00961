"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept and returns a DataFrame. All but the last return the columns
of ``documents``. ``run`` writes every stage's result to the shared folder and
hands the stored table to the next.

Null, empty and blank texts pass every filter (near duplicates keep one of
them); rows with a null id are kept unless their text is rejected; repeated
rows go with the near duplicates; further columns are handed on; an empty
table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crashgrid.llm.bpe import token_digests
from crashgrid.llm.decontaminate import decontaminate
from crashgrid.llm.queries import tokenizer_path
from crashgrid.llm.secret_scan import redact_secrets
from crashgrid.llm.shared import bound_batches, materialize
from crashgrid.llm.simhash import keep_one_per_component
from crashgrid.llm.toxicity import drop_toxic, train_toxicity

#: Learned weights, bit fingerprints and statistical spans are beyond SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from the stage's own input and the labels table."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train_toxicity(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    bound_batches(spark)
    return keep_one_per_component(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    bound_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; n_chars, where there is one, follows a changed text."""
    bound_batches(spark)
    return redact_secrets(docs, length_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, by document."""
    bound_batches(spark)
    return token_digests(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", benchmark_leaks),
          ("secret_scan", secrets), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
