"""Corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import mixing, neardup, passages, tokens, toxicity
from roadweave.llm.common import SMALL_IDS, bounded, small_batches, stored, table, unused

#: Near-duplicates share 80 % of their five-word shingles.
SHINGLE, PERCENT = 5, 80
#: Words of a passage that is taken out, and its similarity.
PASSAGE, SIMILARITY = 50, 0.8
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold; those without text stay."""
    small_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    new = unused(docs, "tox_")
    scored = toxicity.score(docs, model, prefix=new)
    return scored.filter(F.col(f"{new}score") < toxicity.THRESHOLD).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates, once.

    Documents without words are in no class; rows repeated with one id and text go.
    """
    small_batches(spark)
    found = stored(neardup.near_duplicates(docs, k=SHINGLE, percent=PERCENT), "pipeline-classes")
    copies = found.filter("not kept").select("doc_id")
    again = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    gone = bounded(stored(copies.union(again).distinct(), "pipeline-copies"), SMALL_IDS)
    once = docs.join(bounded(stored(again, "pipeline-again"), SMALL_IDS), "doc_id", "left_semi")
    single = docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))
    return single.unionByName(once.select(*_columns(docs)).dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds too; n_chars follows."""
    small_batches(spark)
    found = stored(passages.repeated_passages(docs, least=PASSAGE, similarity=SIMILARITY), "pipeline-passages")
    left = passages.without(docs, found)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return left.select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources ask for."""
    new = unused(docs, "mix_")
    return mixing.emit(mixing.mix(docs, prefix=new), prefix=new)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts of what was emitted, as digests."""
    small_batches(spark)
    return tokens.digests(docs.select("doc_id", "source", "text"), RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("tokens", bpe_tokens),
]

#: SQL cannot train the field or run the joins; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
