"""Boosted trees against a plain version, and the stored model."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.operators import boosting
from roadweave.operators.boosting import PRIME, UNIT, Settings

SMALL = Settings(rounds=12, depth=4, rate=0.3, least=2, gamma=0.05, alpha=0.1, lam=0.5, bins=20)


def frame(spark, n=700, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.choice([None, *range(8)]), r.gauss(0, 1)
        c = r.choice([0.0, float("nan"), 1.5, 1.5, None])
        y = 3.0 * (a or 0) - 2 * (b > 0.3) * (a or 1) + r.gauss(0, 0.1)
        rows.append((i, a, b, c, 7, y if i % 50 else None))
    return rows, spark.createDataFrame(rows, "id long, a int, b double, c double, k int, y double")


def plain(rows, cuts, hashes, first, s):
    """The same trees by loops over rows and all splits."""
    data = [(i, [a, b, c, k], math.floor(y * UNIT + 0.5)) for i, a, b, c, k, y in rows if y is not None]

    def bin_of(f, v):
        return 0 if v is None or v != v else 1 + sum(x <= v for x in cuts[f])

    def shrunk(g):
        return max(abs(g / UNIT) - s.alpha, 0.0)

    bins = {i: [bin_of(f, v) for f, v in enumerate(x)] for i, x, _ in data}
    y = {i: t for i, _, t in data}
    score = dict.fromkeys(y, first)
    trees = []
    for k in range(s.rounds):
        factor, offset, columns = boosting.round_sample(s, k, 4)
        taken = [i for i in y if (hashes[i] * factor + offset) % PRIME < int(s.rows * PRIME)]
        nodes = {}

        def grow(node, members, level):
            g, n = sum(score[i] - y[i] for i in members), len(members)
            best = None
            for f in columns if level < s.depth else ():
                for b in sorted({bins[i][f] for i in members}):
                    left = [i for i in members if bins[i][f] <= b]
                    gl, nl = sum(score[i] - y[i] for i in left), len(left)
                    if nl < s.least or n - nl < s.least:
                        continue
                    part = lambda g, n: shrunk(g) * shrunk(g) / (n + s.lam)
                    gain = part(gl, nl) + part(g - gl, n - nl) - part(g, n)
                    if gain > 0 and gain >= s.gamma and (best is None or gain > best[0]):
                        best = (gain, f, b)
            if best is None:
                nodes[node] = (None, None, n, math.floor(math.copysign(shrunk(g), -g) / (n + s.lam) * s.rate * UNIT + 0.5))
                return
            nodes[node] = (best[1], best[2], n, best[0])
            _, f, b = best
            grow(2 * node + 1, [i for i in members if bins[i][f] <= b], level + 1)
            grow(2 * node + 2, [i for i in members if bins[i][f] > b], level + 1)

        grow(0, taken, 0)
        trees.append(nodes)
        for i in score:
            node = 0
            while nodes[node][0] is not None:
                node = 2 * node + 1 + (bins[i][nodes[node][0]] > nodes[node][1])
            score[i] += nodes[node][3]
    return trees, score


def test_trees_equal_a_plain_version(spark):
    rows, df = frame(spark)
    model = boosting.fit(df.repartition(5), ["a", "b", "c", "k"], "y", ["id"], SMALL)
    hashes = {r.id: r.h for r in df.select("id", boosting.row_hash(["id"]).alias("h")).collect()}
    trees, score = plain(rows, model.cuts, hashes, model.first, SMALL)
    assert len(model.trees) == 12  # more than are scored at once
    for t, nodes in zip(model.trees, trees, strict=True):
        assert set(np.flatnonzero(t.count)) == set(nodes)
        for i, (f, b, n, v) in nodes.items():
            assert t.count[i] == n
            if f is None:
                assert t.feature[i] == -1 and t.value[i] == v
            else:
                assert (t.feature[i], t.bin[i], t.gain[i]) == (f, b, v)
    got = {r.id: r.boosted for r in model.transform(df).collect()}
    assert all(got[i] == v / UNIT for i, v in score.items())
    # far better than the mean
    y = {r[0]: r[5] for r in rows if r[5] is not None}
    mean = sum(y.values()) / len(y)
    assert sum((got[i] - v) ** 2 for i, v in y.items()) < 0.1 * sum((v - mean) ** 2 for v in y.values())


def test_order_of_rows_and_partitions_does_not_matter(spark):
    _, df = frame(spark, 300, 2)
    fit = lambda d: boosting.fit(d, ["a", "b", "c"], "y", ["id"], Settings(rounds=3, depth=3))
    one, two = fit(df.coalesce(1)), fit(df.orderBy(F.rand(3)).repartition(7))
    assert one.splits(spark).collect() == two.splits(spark).collect()


def test_cuts(spark):
    r = random.Random(5)
    values = [(r.choice([0.0, 1.0]) if r.random() < 0.99 else 2.0, math.exp(r.gauss(0, 1)), 4.0, None) for _ in range(3000)]
    df = spark.createDataFrame(values, "_f0 double, _f1 double, _f2 double, _f3 double")
    cuts = boosting.find_cuts(df, 4, 40)
    assert cuts[0] == [1.0, 2.0] and cuts[2] == cuts[3] == []
    ordered = sorted(v[1] for v in values)
    assert len(cuts[1]) == 39 and set(cuts[1]) <= set(ordered)
    ranks = np.searchsorted(ordered, cuts[1])
    assert np.abs(ranks - np.arange(1, 40) * 3000 / 40).max() <= 30


def test_stored_model(spark, tmp_path):
    _, df = frame(spark, 200, 3)
    model = boosting.fit(df, ["a", "b", "c", "k"], "y", ["id"], Settings(rounds=2, depth=2))
    model.save(spark, str(tmp_path / "m"))
    loaded = boosting.Boosted.load(spark, str(tmp_path / "m"))
    score = lambda m: m.transform(df).select("id", "boosted").collect()
    assert score(loaded) == score(model)
    shares = [r.importance for r in loaded.importances(spark).collect()]
    assert len(shares) == 4 and math.isclose(sum(shares), 1.0) and shares[3] == 0


def test_nothing_to_learn(spark):
    _, df = frame(spark, 60)
    with pytest.raises(ValueError):
        boosting.fit(df.where("y is null"), ["a"], "y", ["id"], SMALL)
    flat = boosting.fit(df, ["k"], "y", ["id"], Settings(rounds=2, depth=3))
    assert flat.cuts == [[]] and all((t.feature < 0).all() for t in flat.trees)


def test_search_on_time_folds(spark):
    """Each fold learns from what lies in front of it; one binned table; the best setting is the largest mean."""
    _, df = frame(spark, 400, 6)
    df = df.where("y is not null").withColumn("at", F.timestamp_seconds(F.floor(F.col("id") / 3)))
    grid = {"rounds": [1, 4], "depth": [1, 3], "rate": [0.3]}
    table = boosting.search(df, ["a", "b"], "y", ["id"], "at", "id", grid, 3, 3, Settings(rounds=1)).toPandas()
    assert len(table) == 9 and table.setting.nunique() == 3
    n = df.count()
    ends = [math.floor(n * i / 4) for i in range(5)]
    for i in (1, 2, 3):
        part = table[table.fold == i]
        assert set(part.train_rows) == {ends[i]} and set(part.test_rows) == {ends[i + 1] - ends[i]}
    best = table[table.is_best == 1]
    assert best.setting.nunique() == 1 and best.mean_r2.max() == table.mean_r2.max()
    # a score is that of the model on the fold's rows
    one = table.sort_values("mean_r2").iloc[-1]
    settings = Settings(**json.loads(one.setting))
    order = [r.id for r in df.orderBy("at", "id").select("id").collect()]
    train, test = set(order[: ends[one.fold]]), set(order[ends[one.fold] : ends[one.fold + 1]])
    inside = df.where(F.col("id").isin(list(train)))
    again = boosting.prepare(df, ["a", "b"], "y", ["id"], part=F.col("id").isin(list(train)).cast("int"))
    model = boosting.grow(again, settings, F.col("part") == 1)
    rows = [(r.y, r.boosted) for r in model.transform(df.where(F.col("id").isin(list(test)))).collect()]
    mean = sum(y for y, _ in rows) / len(rows)
    r2 = 1 - sum((y - p) ** 2 for y, p in rows) / sum((y - mean) ** 2 for y, _ in rows)
    assert math.isclose(one.r2, r2, rel_tol=1e-5, abs_tol=1e-5) and inside.count() == one.train_rows


def test_cuts_come_without_a_row_for_each_value(spark):
    """Tasks count by cell; values are not spread over rows. Nulls, one value and infinite ones included."""
    r = random.Random(8)
    rows = [(r.choice([None, float(r.randrange(300))]), r.gauss(0, 1), 5.0, None if i else math.inf, float(i % 3)) for i in range(4000)]
    df = spark.createDataFrame(rows, ", ".join(f"_f{i} double" for i in range(5))).repartition(3)
    plans = []
    listener = spark._jsparkSession.sharedState().statusStore()
    before = listener.executionsCount()
    cuts = boosting.find_cuts(df, 5, 16)
    plans = [listener.executionsList(before + i, 1).head().physicalPlanDescription() for i in range(listener.executionsCount() - before)]
    assert plans and not any("Generate" in p for p in plans)
    for f in (0, 1):
        values = sorted(x[f] for x in rows if x[f] is not None)
        at = [sum(v < c for v in values) / len(values) for c in cuts[f]]
        assert len(at) == 15 and all(abs(x - (i + 1) / 16) < 0.01 for i, x in enumerate(at))
    assert cuts[2] == [] and cuts[3] == [] and cuts[4] == [1.0, 2.0]
