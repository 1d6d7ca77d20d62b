"""Both vector searches against brute force, with every odd kind of vector."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import ann, topk

SCHEMA = "vec_id long, embedding array<double>, label int, id long, block int, part int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [None] * 8), (404, [float("nan")] * 8)]
    rows += [(405, [float("inf")] * 8), (406, [1.0, 2.0]), (420, [1.0, 2.5]), (None, [1.0] * 8), (500, [1e9] * 8)]
    rows += [rows[0], rows[0]]  # repeated rows
    return rows, spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def usable(rows, zero):
    out = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if zero or any(v):
            out[i] = v
    return out


def test_top_k(vectors):
    rows, df = vectors
    data = usable(rows, True)
    got = {}
    for r in topk.top_k(df, F.col("id") % 20 == 0, k=5, shard=64, block=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in data.items()}
    for q in (i for i in whole if i % 20 == 0):
        scores = [(-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        want = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
        assert sorted(got.get(q, [])) == want


def test_top_k_prunes_exactly():
    """Buckets of very different lengths, so that both kinds of pruning work."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    data = rng.standard_normal((3000, 16)) * rng.lognormal(0, 1, 3000)[:, None]
    data[:200] = data[0] + rng.standard_normal((200, 16)) * 0.05
    table = pa.table({"id": np.arange(3000), "vec": pa.array(list(data))})
    asked = table.slice(0, 60)
    got = topk.search(table, asked, 10).to_pandas()
    whole = np.floor(64 * data)
    for q in range(60):
        s = whole @ whole[q]
        want = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:10]
        assert got[got.query_id == q].vec_id.tolist() == want


def test_top_k_of_many_large_components():
    """Sums of 768 products near the limit of doubles stay exact."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    data = rng.uniform(1.0e5, 1.3e5, (40, 768)) + rng.integers(0, 64, (40, 768)) / 64
    table = pa.table({"id": np.arange(40), "vec": pa.array(list(data))})
    got = topk.search(table, table.slice(0, 5), 6).to_pandas()
    whole = [[math.floor(64 * x) for x in v] for v in data.tolist()]
    for q in range(5):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)
        mine = got[got.query_id == q]
        assert [(-s, i) for s, i in zip(mine.score.tolist(), mine.vec_id.tolist(), strict=True)] == scores[:6]


def test_nearest_recall_and_order(vectors):
    rows, df = vectors
    data = usable(rows, False)
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for q in (i for i in data if i % 20 == 0):
        near = sorted((math.dist(data[q], v), i) for i, v in data.items() if i != q and len(v) == len(data[q]))[:5]
        found = got.get(q, [])
        assert [s for _, s in found] == sorted(s for _, s in found)
        for i, s in found:
            assert s == pytest.approx(math.dist(data[q], data[i]), abs=1e-12)
        hit += len({i for _, i in near} & {i for i, _ in found})
        total += len(near)
    assert hit / total >= 0.9
    assert 402 not in {i for v in got.values() for i, _ in v}
    # other dimensions are searched whole; ties go to the smaller id
    assert [i for i, _ in got[420]] == [406]
    assert [i for i, _ in got[320]] == [7, 300, 301, 302, 303]


def test_recall_on_given_vectors(spark, sf):
    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    got = ann.nearest(df, F.col("id") % 100 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("f")).toPandas()
    pdf = df.toPandas()
    ids, data = pdf.vec_id.to_numpy(), np.stack(pdf.embedding.map(np.asarray)).astype(float)
    hit = 0
    for q, f in zip(got.query_id, got.f, strict=True):
        d = ((data - data[ids == q][0]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hit += len(set(ids[np.argsort(d)[:10]]) & set(f))
    assert hit / (10 * len(got)) >= 0.9


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(empty, F.col("id") % 20 == 0).count() == 0
