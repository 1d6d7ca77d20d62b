"""Vector rows and blocks of them, shared by the exact and the approximate search."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.llm.common import stored


def valid(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """Rows (id, dim, vec) whose vector is there with finite components only.

    Of several rows with one id the smallest vector stays. Rows without id or components
    take no part; all-zero vectors only if ``zero``.
    """
    v = F.col(vector)
    infinite = F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))
    rows = df.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("vec")).filter(
        F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    )
    if not zero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).select("id", F.size("vec").alias("dim"), "vec")


def parts(rows: int, most: int) -> int:
    return max(1, math.ceil(rows / most))


def matrix(table: pa.Table, column: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one block, ordered by id."""
    ids = table["id"].combine_chunks().to_numpy(zero_copy_only=False)
    flat = table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    data = flat.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], data[order]


def blocks(rows: DataFrame, most: int, salt: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``block``, so that each block of equal ``keys`` has about ``most`` rows,
    and the table of (keys, blocks): how many there are."""
    counts = stored(
        rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks")), "vector-blocks"
    )
    cut = rows.join(counts, list(keys)).withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), "blocks").cast("int"))
    return cut.drop("blocks"), counts


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k best rows (query_id, rank, vec_id, score) of each query, ties to the smaller id."""
    score = F.desc("score") if descending else F.asc("score")
    order = W.partitionBy("query_id").orderBy(score, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
