"""Approximate nearest neighbours by learned partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import stored
from roadweave.llm.vectors import best, blocks, matrix, valid

#: The partitions are learned from this many vectors, those with the smallest hashes of their
#: ids; every vector is indexed.
SAMPLE = 6_000
#: Parts, as a power of two, and neighbours of a vector in the graph.
LEVELS, NEIGHBOURS = 5, 10
#: A query visits its most probable parts until they hold this probability, FEWEST at least.
MASS, FEWEST = 0.985, 6
#: Rows and queries that meet in one task.
BLOCK, QUERIES = 8_192, 4_096

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def neighbour_graph(data: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    n, k = len(data), min(k, len(data) - 1)
    square = (data**2).sum(axis=1)
    out = np.empty((n, k), dtype=np.int64)
    for a in range(0, n, 512):
        far = square[None, :] - 2 * data[a : a + 512] @ data.T
        far[np.arange(far.shape[0]), np.arange(a, a + far.shape[0])] = np.inf
        out[a : a + 512] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def halves(edges: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A balanced cut of a graph: the median of the second eigenvector of the random walk,
    then swaps of the vertices that gain most."""
    degree = np.maximum(np.bincount(edges[:, 0], minlength=n), 1)
    x = np.random.default_rng(seed).standard_normal(n)
    for _ in range(60):
        x = (x + np.bincount(edges[:, 0], weights=x[edges[:, 1]], minlength=n) / degree) / 2
        x -= (x * degree).sum() / degree.sum()
        x /= max(np.linalg.norm(x), 1e-12)
    side = np.zeros(n, dtype=bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        cross = side[edges[:, 0]] != side[edges[:, 1]]
        gain = np.bincount(edges[:, 0], weights=np.where(cross, 1.0, -1.0), minlength=n)
        left, right = np.nonzero(~side)[0], np.nonzero(side)[0]
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 2).sum()) // 2
        if not good:
            break
        side[left[:good]], side[right[:good]] = True, False
    return side


def balanced_parts(graph: np.ndarray, levels: int) -> np.ndarray:
    """Parts of nearly equal size with few edges between them, by repeated halving."""
    n = len(graph)
    pairs = np.column_stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    pairs = np.concatenate([pairs, pairs[:, ::-1]])
    part = np.zeros(n, dtype=np.int64)
    for level in range(levels):
        same = part[pairs[:, 0]] == part[pairs[:, 1]]
        kept = pairs[same]
        after = part * 2
        for p in range(1 << level):
            own = np.nonzero(part == p)[0]
            if len(own) < 2:
                continue
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = kept[part[kept[:, 0]] == p]
            after[own] += halves(place[inside], len(own), seed=level * 1000 + p)
        part = after
    return part


class Router:
    """A network with one hidden layer: the probability of each part."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        hidden = np.maximum((data - self.mean) / self.scale @ self.w1 + self.b1, 0)
        z = hidden @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(data: np.ndarray, levels: int = LEVELS, neighbours: int = NEIGHBOURS, hidden: int = 128, epochs: int = 60):
    """The router of a sample. Its labels are soft: the parts of a row and its neighbours."""
    n = len(data)
    levels = max(0, min(levels, int(np.log2(max(n, 1) / 16)) if n >= 16 else 0))
    count = 1 << levels
    rng = np.random.default_rng(0)
    mean, scale = data.mean(axis=0), data.std() + 1e-12
    x = (data - mean) / scale
    w1 = rng.standard_normal((data.shape[1], hidden)) * np.sqrt(2 / data.shape[1])
    w2 = rng.standard_normal((hidden, count)) * np.sqrt(1 / hidden)
    b1, b2 = np.zeros(hidden), np.zeros(count)
    if count > 1:
        graph = neighbour_graph(data, neighbours)
        part = balanced_parts(graph, levels)
        label = np.eye(count)[part] + np.eye(count)[part[graph]].sum(axis=1)
        label /= label.sum(axis=1, keepdims=True)
        weights = [w1, b1, w2, b2]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, 128):
                rows = order[a : a + 128]
                h = np.maximum(x[rows] @ w1 + b1, 0)
                z = h @ w2 + b2
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                dz = (p - label[rows]) / len(rows)
                dh = dz @ w2.T * (h > 0)
                step += 1
                for i, g in enumerate((x[rows].T @ dh + 1e-4 * w1, dh.sum(0), h.T @ dz + 1e-4 * w2, dz.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    weights[i] -= 0.002 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, w1, b1, w2, b2)


def visited(p: np.ndarray, mass: float, fewest: int) -> list[list[int]]:
    """The parts each query visits, most probable first."""
    order = np.argsort(-p, axis=1, kind="stable")
    held = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    n = np.maximum((held < mass).sum(axis=1) + 1, fewest)
    return [row[:c].tolist() for row, c in zip(order, n, strict=True)]


def rerank(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of one block (left) for each query (right), by exact distance."""
    if not left.num_rows or not right.num_rows:
        return FOUND.empty_table()
    ids, data = matrix(left)
    query_ids, query = matrix(right)
    square = (data**2).sum(axis=1)
    out = []
    for a in range(0, len(query), 256):
        q = query[a : a + 256]
        own = (q**2).sum(axis=1)
        about = np.maximum(square[None, :] - 2 * q @ data.T + own[:, None], 0)
        about[query_ids[a : a + 256, None] == ids[None, :]] = np.inf
        kth = np.partition(about, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        # room for the rounding of the shorter formula
        limit = kth + 1e-9 * (own + square.max() + 1)
        for j in range(len(q)):
            near = np.nonzero((about[j] <= limit[j]) & np.isfinite(about[j]))[0]
            exact = np.sqrt(((data[near] - q[j]) ** 2).sum(axis=1))
            first = np.lexsort((ids[near], exact))[:k]
            out.append((np.full(len(first), query_ids[a + j]), ids[near][first], exact[first]))
    return pa.table([np.concatenate([x[i] for x in out]) for i in range(3)], schema=FOUND)


def nearest(
    df: DataFrame,
    queries: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
    mass: float = MASS,
    fewest: int = FEWEST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k nearest vectors by Euclidean distance.

    ``queries`` is a condition on the column ``id``. A neighbour graph of a bounded sample is
    cut into balanced parts, a small classifier learns them, puts every vector into its most
    probable part and sends queries to several, whose vectors are reranked by exact
    distance. Vectors that are null, empty, zero, or hold null or non-finite components take
    no part, nor do rows without id; of rows with one id the smallest vector counts. The
    classifier is learned for the sample's most frequent dimension; vectors of any other
    dimension are compared with all of theirs. Ties go to the smaller id. Large parts are
    divided into blocks. An empty table gives no rows.
    """
    rows = stored(valid(df, key, vector, zero=False), "ann-rows")
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    dims = pd.Series([r.dim for r in chosen], dtype="int64")
    dim = int(dims.mode()[0]) if len(dims) else 0
    router = fit(np.array([r.vec for r in chosen if r.dim == dim])) if dim else None

    def indexed(batches):
        for batch in batches:
            out = []
            for d, vec in zip(batch["dim"].to_pylist(), batch["vec"].to_pylist(), strict=True):
                out.append(vec if d == dim else None)
            at = [i for i, v in enumerate(out) if v is not None]
            part = np.zeros(batch.num_rows, dtype=np.int32)
            goes = [[0]] * batch.num_rows
            if at:
                p = router.probabilities(np.array([out[i] for i in at]))
                part[at] = p.argmax(axis=1)
                for i, visit in zip(at, visited(p, mass, fewest), strict=True):
                    goes[i] = visit
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("id", "dim", "vec")), pa.array(part), pa.array(goes, pa.list_(pa.int32()))],
                names=["id", "dim", "vec", "part", "goes"],
            )

    index = stored(
        rows.mapInArrow(indexed, "id long, dim int, vec array<double>, part int, goes array<int>"), "ann-index"
    )
    cut, sizes = blocks(index.drop("goes"), BLOCK, 0, "dim", "part")
    asked = index.filter(queries).select("id", "dim", "vec", F.explode("goes").alias("part"))
    asked, asks = blocks(asked, QUERIES, 1, "dim", "part")
    left = (
        cut.withColumnRenamed("block", "own")
        .join(asks, ["dim", "part"])
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    right = asked.join(sizes, ["dim", "part"]).withColumn(
        "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    keys = ["dim", "part", "own", "block"]
    found = (
        left.select(*keys, "id", "vec")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "id", "vec").toDF(*keys, "id", "vec").groupBy(*keys))
        .applyInArrow(lambda a, b: rerank(a, b, k), "query_id long, vec_id long, score double")
    )
    return best(found, k, descending=False)
