import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.operators import align, series, split

T0 = dt.datetime(2024, 1, 1)


def history(spark, seed, keys=3, rows=120, hours=80):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(keys)}"
        when = T0 + dt.timedelta(minutes=rng.randrange(hours * 60))
        when = None if i == 9 else when
        data.append((key, when, i, float(rng.randrange(100)) if rng.random() > 0.05 else None))
    return spark.createDataFrame(data, "k string, t timestamp, i int, v double")


@pytest.mark.parametrize("parts", [None, 1, 7, 60])
def test_split_windows_equal_plain_windows(spark, parts):
    df = history(spark, 7)
    w = Window.partitionBy("k").orderBy("t", "i")

    def build(win):
        f = win.rowsBetween(-4, 0)
        return {
            "l1": F.lag("v", 1).over(win),
            "l4": F.lag("v", 4).over(win),
            "a2": F.lead("v", 2).over(win),
            "m": F.avg("v").over(f),
            "n": F.count("v").over(f),
            "lst": F.collect_list("v").over(win.rowsBetween(-4, 2)),
        }

    got = series.over_rows(df, ["k"], ["t", "i"], ["v"], build, before=4, after=2, parts=parts)
    want = df.withColumns(build(w))
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = sorted(map(repr, got.select(*cols).collect()))
    assert a == sorted(map(repr, want.select(*cols).collect()))


def check_bounded(spark, df, parts, reach):
    """Parts are bounded, border rows few, and values those of the plain window."""
    cut = series._ranged(df, ["k"], ["t", "i"], parts)
    sizes = [r["count"] for r in cut.groupBy(series._PART).count().collect()]
    assert max(sizes) <= 4 * df.count() / parts
    for forward in (True, False):
        lean = cut.select("k", "t", "i", "v", series._PART)
        halo = series._halo_rows(lean, ["k"], ["t", "i"], reach, forward)
        assert halo.count() <= reach * (len(sizes) + df.select("k").distinct().count())

    def build(w):
        return {"l3": F.lag("v", 3).over(w), "m": F.avg("v").over(w.rowsBetween(-3, 2))}

    got = series.over_rows(df, ["k"], ["t", "i"], ["v"], build, before=3, after=2, parts=parts)
    want = df.withColumns(build(Window.partitionBy("k").orderBy("t", "i")))
    cols = sorted(want.columns)
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))


def test_one_long_key_is_cut(spark):
    rows = [("a", T0 + dt.timedelta(seconds=7 * i), i, float(i % 13)) for i in range(600)]
    check_bounded(spark, spark.createDataFrame(rows, "k string, t timestamp, i int, v double"), 12, 3)


def test_one_instant_is_cut_by_its_tie(spark):
    noon = T0 + dt.timedelta(hours=12)
    rows = [("a", noon, i, float(i % 13)) for i in range(600)]
    rows += [("a", noon + dt.timedelta(minutes=m), 900 + m, float(m)) for m in (-2, -1, 1, 2)]
    rows += [("b", noon, 7, 1.0)]
    check_bounded(spark, spark.createDataFrame(rows, "k string, t timestamp, i int, v double"), 12, 3)


def test_later_value_is_that_of_the_time(spark):
    def at(minute):
        return T0 + dt.timedelta(hours=23, minutes=minute)

    rows = [("a", c, at(m), n, float(100 * c + m)) for n, (m, c) in enumerate((m, c) for m in range(0, 121, 5) for c in range(5))]
    rows += [("a", 0, at(7), 999, -1.0), ("a", 0, None, 998, -2.0), ("a", 1, at(15), 997, 9999.0)]
    df = spark.createDataFrame(rows, "k string, c int, t timestamp, pos int, v double")
    out = series.later(df, ["k", "c"], "t", "v", 15, first=["pos"])
    assert out.count() == len(rows)
    for r in out.collect():
        minute = None if r.t is None else (r.t - at(0)).total_seconds() / 60
        known = minute is not None and minute % 5 == 0 and minute + 15 <= 120
        assert r.v_in_15_min == (100 * r.c + minute + 15 if known else None)


def test_rolling_first_row_and_lag_borders(spark):
    rows = [("a", T0, 1.0), ("a", T0 + dt.timedelta(minutes=5), 3.0), ("b", T0, 9.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double")
    out = series.lags_and_rolling(df, ["k"], ["t"], ["v"], periods=(1,), windows=(3,), horizon=1)
    got = {(r["k"], r["t"]): r for r in out.collect()}
    first = got["a", T0]
    assert first["v_rolling_std_3"] is None and first["v_rolling_mean_3"] == 1.0
    assert first["v_lag_1"] is None and first["v_ahead_1"] == 3.0
    assert got["b", T0]["v_lag_1"] is None


def test_sequences_are_complete_only(spark):
    rows = [("a", T0 + dt.timedelta(minutes=5 * i), float(i)) for i in range(20)]
    rows += [("b", T0 + dt.timedelta(minutes=5 * i), float(i)) for i in range(14)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double")
    out = series.sequences(df, ["k"], ["t"], ["v"], "v").orderBy("t").collect()
    assert len(out) == 6
    assert out[0]["x"] == [[float(i)] for i in range(12)] and out[0]["y"] == [12.0, 13.0, 14.0]


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, t timestamp, i int, v double")
    assert series.lags(df, ["k"], ["t", "i"], ["v"]).count() == 0
    assert series.latest(df, ["k"], ["t"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_kth_smallest(spark, seed):
    rng = random.Random(seed)
    values = [rng.randrange(-(10**12), 10**15) for _ in range(300)] + [5] * 150
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values)
    for k in (1, 77, 225, 450):
        value, below = split.kth_smallest(df, "v", k)
        assert value == ordered[k - 1]
        assert below == sum(1 for v in values if v < value)


def test_chronological_split_with_ties(spark):
    rows = [(T0 + dt.timedelta(hours=i // 40), i) for i in range(103)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "t timestamp, i long")
    out = split.chronological_split(df, "t", "i", 0.8)
    train = {r["i"] for r in out.where("is_train = 1").collect()}
    assert train == set(range(82))


def test_chronological_split_leaves_rows_without_time_out(spark):
    rows = [(T0 + dt.timedelta(minutes=i), i) for i in range(700)] + [(None, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "t timestamp, i long")
    out = split.chronological_split(df, "t", "i", 0.8)
    sizes = {r["is_train"]: r["count"] for r in out.groupBy("is_train").count().collect()}
    assert sizes == {1: 560, 0: 140, None: 300}
    with pytest.raises(ValueError):
        split.kth_smallest(df.select("i"), "i", 1001)


def test_sample_exact_sizes_and_repeatability(spark):
    df = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("d")
    )
    a = split.sample_exact(df, "d", ["id"], 0.3)
    sizes = {r["d"]: r["count"] for r in a.groupBy("d").count().collect()}
    assert sizes == {"small": 150, "large": 1350}
    b = split.sample_exact(df.repartition(7), "d", ["id"], 0.3)
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}


def test_preview_equals_plain_rank(spark):
    df = spark.range(400).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("date"),
        (F.col("id") % 2).alias("g"),
        F.col("id"),
    )
    got = {r["id"] for r in split.preview(df, "date", ["g"], ["id"], days=3, rows=4).collect()}
    want = set()
    for d in range(3):
        for g in range(2):
            want |= set([i for i in range(400) if i % 5 == d and i % 2 == g][:4])
    assert got == want


@pytest.mark.parametrize("tolerance", [30, 300, 900])
@pytest.mark.parametrize("same_day", [True, False])
def test_nearest_join_equals_brute_force(spark, tolerance, same_day):
    rng = random.Random(tolerance)
    left = [
        (rng.choice("ab"), i, T0 + dt.timedelta(seconds=rng.randrange(2 * 86400))) for i in range(300)
    ]
    left += [("a", 1000 + i, T0 + dt.timedelta(hours=24)) for i in range(50)]  # one hot instant
    right = {
        (rng.choice("ab"), T0 + dt.timedelta(seconds=60 * rng.randrange(2880))) for _ in range(400)
    }
    right = [(k, t, float(n)) for n, (k, t) in enumerate(sorted(right))]
    got = align.nearest_join(
        spark.createDataFrame(left, "k string, i int, t timestamp"),
        spark.createDataFrame(right, "k string, rt timestamp, v double"),
        ["k"],
        "t",
        "rt",
        ["v"],
        tolerance,
        same_day,
    )
    want = set()
    for k, i, t in left:
        near = [
            (abs((t - rt).total_seconds()), rt, v)
            for rk, rt, v in right
            if rk == k and (not same_day or rt.date() == t.date())
        ]
        near = [n for n in near if n[0] <= tolerance]
        if near:
            _, rt, v = min(near)
            want.add((k, i, rt, v))
    assert {(r["k"], r["i"], r["rt"], r["v"]) for r in got.collect()} == want


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_stored_series_need_no_exchange(spark, tmp_path, parts):
    """Frames over the stored layout equal plain windows, also of a hot key in many ranges, without a shuffle."""
    df = history(spark, 11, rows=400)
    held = series.SeriesTable.store(df, f"held_{parts}", str(tmp_path / "t"), ["k"], ["t", "i"], 4, 2, parts)
    w = Window.partitionBy("k").orderBy("t", "i")

    def build(win):
        return {"l4": F.lag("v", 4).over(win), "a2": F.lead("v", 2).over(win), "m": F.avg("v").over(win.rowsBetween(-4, 0))}

    got = series.over_rows(held, ["k"], ["t", "i"], ["v"], build, before=4, after=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    want = df.withColumns(build(w))
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))
    # each range has a bucket of its own, and the ranges are about equal
    sizes = [r["count"] for r in held.frame.where("not _series_halo").groupBy("_series_part").count().collect()]
    assert len(held.frame.inputFiles()) == len(sizes) and max(sizes) <= 3 * 400 / len(sizes) + 10
    with pytest.raises(ValueError):
        series.over_rows(held, ["k"], ["t", "i"], ["v"], build, before=5)
    with pytest.raises(ValueError):
        series.over_rows(held, ["k"], ["t"], ["v"], build, before=1)
