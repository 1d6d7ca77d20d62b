"""Exact top-k inner products by norm buckets with length and coordinate pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import stored
from roadweave.llm.vectors import best, blocks, matrix, valid

#: Rows of a shard of candidates, of a block of queries, and of a norm bucket inside a shard.
SHARD, QUERIES, BUCKET = 16_384, 2_048, 512
#: Above this local cosine threshold coordinates prune, below it lengths do.
COSINE = 0.5
#: Coordinates that prune, the largest of the query.
FOCUS = 3
#: Shares of a threshold left as room for rounding.
ROOM = 1e-9

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole(data: np.ndarray) -> np.ndarray:
    """floor(64 * x), as doubles while sums of products stay exact in them, else as Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(64.0 * data)
    if out.size and not np.abs(out).max() ** 2 * out.shape[1] < 2.0**53:
        big = [[int(np.floor(x)) * 64 + int(np.floor((x - np.floor(x)) * 64)) for x in row] for row in data.tolist()]
        return np.array(big, dtype=object)
    return out


class Top:
    """The k best (score, id) so far of each query."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.empty(0)] * queries
        self.id = [np.empty(0, dtype=np.int64)] * queries
        self.least = np.full(queries, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least[q]
        if not keep.any():
            return
        s = np.concatenate([self.score[q], scores[keep]])
        i = np.concatenate([self.id[q], ids[keep]])
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]
        if len(order) == self.k:
            self.least[q] = float(s[order[-1]])


def candidates(q: np.ndarray, unit: np.ndarray, columns: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of a bucket whose cosine with the unit query may reach ``cosine``.

    A coordinate f of such a row lies within q_f * cosine -+ sqrt((1 - q_f^2)(1 - cosine^2));
    ``columns`` holds each coordinate's values in order and the rows they belong to.
    """
    focus = np.argsort(-np.abs(q))[:FOCUS]
    spans = []
    for f in focus:
        half = np.sqrt(max(0.0, 1 - q[f] ** 2) * max(0.0, 1 - cosine**2))
        low, high = q[f] * cosine - half - ROOM, q[f] * cosine + half + ROOM
        # beyond the point where the row's coordinate equals the query's, any larger cosine is allowed too
        if q[f] >= cosine:
            high = 1 + ROOM
        if -q[f] >= cosine:
            low = -1 - ROOM
        values, rows = columns[f]
        a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
        spans.append((b - a, rows[a:b], f, low, high))
    spans.sort(key=lambda s: s[0])
    rows = spans[0][1]
    for _, _, f, low, high in spans[1:]:
        values = unit[rows, f]
        rows = rows[(values >= low) & (values <= high)]
    return rows


def search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one shard (left) for each query of one block (right)."""
    if not left.num_rows or not right.num_rows:
        return FOUND.empty_table()
    ids, data = matrix(left)
    query_ids, query = matrix(right)
    data, query = whole(data), whole(query)
    if data.dtype != query.dtype:
        data, query = data.astype(object), query.astype(object)
    norms = np.sqrt((data.astype(float) ** 2).sum(axis=1))
    query_norms = np.sqrt((query.astype(float) ** 2).sum(axis=1))
    by_norm = np.lexsort((ids, -norms))
    ids, data, norms = ids[by_norm], data[by_norm], norms[by_norm]
    top = Top(len(query), k)
    for a in range(0, len(ids), BUCKET):
        own, rows, lengths = ids[a : a + BUCKET], data[a : a + BUCKET], norms[a : a + BUCKET]
        longest = lengths[0]
        reach = query_norms * longest * (1 + ROOM) + ROOM
        alive = np.nonzero(reach >= top.least)[0]
        if not len(alive):
            break  # shorter buckets reach no query either
        # at +1 where a query has no length, so that its bucket is scanned by length
        bound = np.where(reach[alive] > 0, top.least[alive] / np.maximum(reach[alive], ROOM), -1.0)
        plain = alive[~(bound > COSINE)]
        if len(plain):
            scores = query[plain] @ rows.T
            for j, q in enumerate(plain):
                # rows shorter than threshold / query length cannot reach it
                least = top.least[q] / query_norms[q] * (1 - ROOM) if query_norms[q] > 0 and top.least[q] > 0 else -1.0
                n = np.searchsorted(-lengths, -least, "right")
                other = own[:n] != query_ids[q]
                top.add(q, scores[j, :n][other], own[:n][other])
        steep = [(q, c) for q, c in zip(alive, bound, strict=True) if c > COSINE]
        if steep:
            unit = rows.astype(float) / np.maximum(lengths, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            columns = [(unit[order[:, f], f], order[:, f]) for f in range(unit.shape[1])]
            for q, cosine in steep:
                near = candidates(query[q].astype(float) / query_norms[q], unit, columns, min(1.0, cosine * (1 - ROOM)))
                near = near[own[near] != query_ids[q]]
                if len(near):
                    top.add(q, rows[near] @ query[q], own[near])
    n = [len(x) for x in top.id]
    scores = [min(max(int(s), -(2**63)), 2**63 - 1) for x in top.score for s in x]
    return pa.table([np.repeat(query_ids, n), np.concatenate(top.id), pa.array(scores, pa.int64())], schema=FOUND)


def top_k(
    df: DataFrame,
    queries: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    shard: int = SHARD,
    block: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query.

    ``queries`` is a condition on the column ``id``. Components count as floor(64 * x).
    Vectors that are null, empty, or hold null or non-finite components take no part, nor do
    rows without id; of rows with one id the smallest vector counts. Only vectors of equal
    dimension are compared; ties go to the smaller id; scores beyond 64 bits are held at
    their limits. An empty table gives no rows.

    Shards of bounded size meet blocks of queries of bounded size. Inside a pair, candidates
    stand in buckets by falling length, so thresholds rise early.
    """
    rows = stored(valid(df, key, vector, zero=True), "topk-rows")
    cut, shards = blocks(rows, shard, 0, "dim")
    asked, asks = blocks(rows.filter(queries), block, 1, "dim")
    left = (
        cut.withColumnRenamed("block", "shard")
        .join(asks, "dim")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "shard", "block", "id", "vec")
    )
    right = (
        asked.join(shards, "dim")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "shard", "block", "id", "vec")
        .toDF("dim", "shard", "block", "id", "vec")  # columns of its own, apart from those of left
    )
    keys = ["dim", "shard", "block"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(lambda a, b: search(a, b, k), "query_id long, vec_id long, score long")
    )
    return best(found, k, descending=True)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
