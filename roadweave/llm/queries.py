"""One query for each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import (
    ann,
    html,
    licenses,
    mixing,
    neardup,
    passages,
    periods,
    quality,
    sharding,
    spelling,
    tokens,
    topk,
    toxicity,
)
from roadweave.llm.common import small_batches, table
from roadweave.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_mixing", mixing.ORACLE)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """The mix of all documents: how many words of each are taken."""
    docs = table(spark, sf, "documents", "doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


@query("op2_sharding")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    return sharding.shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_licenses", licenses.oracle())
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, sf, "documents", "doc_id", "text")).drop("matches")


@query("op6_top_k", topk.ORACLE)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    return topk.top_k(table(spark, sf, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0)


@query("op7_nearest")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """About the 10 nearest of every hundredth vector among all others."""
    return ann.nearest(table(spark, sf, "embeddings", "vec_id", "embedding"), F.col("id") % 100 == 0)


@query("op3_near_duplicates")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """The near-duplicate class of every document: three-word shingles, similarity 0.85 or more."""
    small_batches(spark)
    return neardup.near_duplicates(table(spark, sf, "documents", "doc_id", "text"), k=3, percent=85)


@query("op8_main_text")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    small_batches(spark)
    pages = table(spark, sf, "pages", "page_id", "url", "html")
    return html.extract(pages, html.learn(pages))


@query("op9_passages")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage of 50 words or more that an earlier document holds too."""
    small_batches(spark)
    return passages.repeated_passages(table(spark, sf, "documents", "doc_id", "text"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """The toxicity of every document."""
    small_batches(spark)
    docs = table(spark, sf, "documents", "doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("tox_starts").alias("spans"),
    )


#: Vocabulary of op5 and of the pipeline.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op5_tokens")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's token ids and the text decoded from them, as digests."""
    small_batches(spark)
    return tokens.digests(table(spark, sf, "documents", "doc_id", "text"), RANKS, public_tokenizers.PATTERN)


@query("op11_periods")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """The periodic runs of every document, every tenth of which repeats a stretch of its words."""
    small_batches(spark)
    docs = periods.planted(table(spark, sf, "documents", "doc_id", "text"))
    return periods.digests(periods.periodic_runs(docs))


@query("op12_quality", quality.oracle())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """The quality rules' verdict on every document."""
    docs = table(spark, sf, "documents", "doc_id", "lang", "text")
    return quality.rules(docs, table(spark, sf, "labels", "doc_id", "quality")).drop("failed")


@query("op13_spelling", spelling.ORACLE)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """The spelling variants among the words of all documents, one in 199 of which lost a letter."""
    runs = spelling.letter_runs(table(spark, sf, "documents", "doc_id", "text"))
    return spelling.variants(spelling.vocabulary(spelling.misspelt(runs)))
