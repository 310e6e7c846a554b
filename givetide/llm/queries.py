"""One registered query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from givetide.llm import collocations, conversations, decontaminate, extract, jaccard, licenses, lm, mixing, pii, quality, shards, sql, tokens, topk
from givetide.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(sql.STATEMENTS)


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark, sf_dir):
    return tokens.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_shards(spark, sf_dir):
    return shards.shard_documents(table(spark, sf_dir, "documents"), 24)


@query
def op8_mix(spark, sf_dir):
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("source"))


@query
def op6_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_decontaminate(spark, sf_dir):
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_jaccard_join(spark, sf_dir):
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op4_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op3_main_text(spark, sf_dir):
    return extract.main_text(spark, table(spark, sf_dir, "pages"))


@query
def op10_lm_scores(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents"))


@query
def op11_personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_repair(spark, sf_dir):
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
