"""From raw documents to token files: reject, deduplicate, decontaminate, mix, encode.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written before the next stage reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from givetide.llm import decontaminate, jaccard, mixing, quality, tokens
from givetide.llm.common import forget, table
from givetide.llm.queries import tokenizer_path
from givetide.sources.warehouse import RUN, release, run_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays within their language's limit."""
    return quality.keep_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles: the one with the least id.

    Documents without words are linked with nothing and all stay.
    """
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontaminate.benchmark_matches(docs, table(spark, sf_dir, "benchmark"), keep=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: its row is repeated, or left out."""
    return mixing.mixed_documents(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each document."""
    return tokens.token_files(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", encode),
]

#: The classifier, the tokenizer and the joins on shingles are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


@contextmanager
def inner_tables(spark: SparkSession) -> Iterator[None]:
    """A folder for what a stage settles, deleted once the stage is written, or has failed."""
    before = spark.conf.get(RUN, None)
    spark.conf.set(RUN, uuid.uuid4().hex)
    try:
        yield
    finally:
        release(spark)
        spark.conf.unset(RUN)
        if before:
            spark.conf.set(RUN, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's rows are deleted when the next stage is written, and its inner tables when it is written itself. The token
    files, in the folder of the run around, and the last stage's rows stay.
    """
    docs, home = table(spark, sf_dir, "documents"), f"{run_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES, 1):
        path, former = f"{home}/{name.split()[0].replace('/', '-')}", docs
        if n < len(STAGES):
            with inner_tables(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
        else:
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if n > 1:
            forget(former)
    return docs
