"""Streams over several batches: keyed history, merged states, late rows, appends by the hour."""

import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import align, features, series, summary
from roadweave.registry import live, views
from roadweave.sources import tables
from roadweave.streaming import history, jobs
from roadweave.streaming.merged import MergedTable


def as_set(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df.select(*[F.col(c).cast("string") for c in cols]).collect()), key=str)


def lane_rows(spark, n=400, seed=3):
    """Rows of three lanes, a minute apart on average, with null speeds."""
    r = random.Random(seed)
    rows = [(i, f"v{r.randrange(3)}", r.choice([None, *map(float, range(20, 90))])) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, vd_id string, speed double")
    return df.withColumn("update_time", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i") * 61))


def test_history_over_batches_with_late_rows(spark, tmp_path):
    """Rows arrive up to nine minutes late, in four batches; the values equal those of the sorted table."""
    rows = lane_rows(spark)
    arrival = rows.withColumn("_at", F.col("i") + F.pmod(F.hash("i"), F.lit(9)))
    feed = live.ordered_batches(spark, arrival, "_at", 4)
    stream = history.with_history(feed, ["vd_id"], ["update_time"], ["speed"], 12)
    jobs.write_available(series.from_history(stream, ["speed"]), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = series.lags_and_rolling(rows, ["vd_id"], ["update_time"], ["speed"])
    last = rows.agg(F.max("update_time")).first()[0]
    want = want.where(F.col("update_time") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    rounded = [F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in want.dtypes]
    assert as_set(got.select(*want.columns).select(*rounded)) == as_set(want.select(*rounded))


def test_forgotten_key_starts_anew(spark, tmp_path):
    rows = [(1, "a", 10.0), (2, "a", 20.0), (500, "b", 1.0), (1000, "b", 1.0), (2000, "a", 30.0), (9000, "b", 1.0)]
    df = spark.createDataFrame(rows, "i long, vd_id string, speed double").withColumn(
        "update_time", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i") * 60)
    )
    feed = live.ordered_batches(spark, df.withColumn("_at", F.col("i")), "_at", 6)
    stream = history.with_history(feed, ["vd_id"], ["update_time"], ["speed"], 3, keep="10 hours")
    jobs.write_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.i: r["_before_speed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == [] and got[2] == [10.0] and got[2000] == [] and got[1000] == [1.0]


def test_streamed_station_features_have_the_batch_columns(spark, sf, tmp_path):
    vd = views.snapshots(spark, sf)
    want = features.station_features(vd, encoding=features.station_encoding(vd))
    path = str(tmp_path / "in")
    vd.write.parquet(path)
    stream = spark.readStream.schema(vd.schema).parquet(path)
    got = features.streamed_station_features(stream, encoding=features.station_encoding(vd))
    assert set(got.columns) == set(want.columns)


def test_merged_table_takes_a_batch_once(spark, tmp_path):
    state = MergedTable(str(tmp_path / "state"), ("k",), {"n": "sum", "top": "max"}, fold=3)
    r = random.Random(1)
    total, top = {}, {}
    for batch in range(9):
        rows = [(f"2024-01-0{r.randrange(1, 4)}", r.choice("ab"), r.randrange(9), r.random()) for _ in range(6)]
        df = spark.createDataFrame(rows, "d string, k string, n long, top double").select(F.to_date("d").alias("date"), "k", "n", "top")
        for d, k, n, t in rows:
            total[d, k] = total.get((d, k), 0) + n
            top[d, k] = max(top.get((d, k), 0.0), t)
        dates = state.add(df, batch)
        assert {str(d) for d in dates} == {d for d, *_ in rows}
        state.add(df, batch)  # the batch ran again after its mark
        if batch % 2:
            tables.remove(spark, state._done(batch))
            state.add(df, batch)  # and before it
        every = [F.lit(f"2024-01-0{i}").cast("date") for i in (1, 2, 3)]
        every = [spark.range(1).select(d).first()[0] for d in every]
        got = {(str(x.date), x.k): (x.n, x.top) for x in state.read(spark, every).collect()}
        assert got == {key: (total[key], top[key]) for key in total}
    assert state.read(spark, ["2030-01-01"]) is None
    live_parts = spark.read.parquet(str(tmp_path / "state")).select("date", "kind", "batch").distinct()
    assert live_parts.where("kind = 'base'").count() and live_parts.count() <= 3 * 6


def test_day_summary_rerun_batch(spark, sf, tmp_path):
    """A batch that is run again, and rows that come again, count once."""
    vd = views.readings(spark, sf)
    sink = jobs.update_day_summary(str(tmp_path / "rows"), str(tmp_path / "days"))
    parts = [vd.where(F.pmod(F.hash("update_time"), F.lit(3)) == i) for i in range(3)]
    sink(parts[0], 0)
    sink(parts[1], 1)
    sink(parts[1], 1)
    sink(parts[2].unionByName(parts[0]), 2)
    got = spark.read.parquet(str(tmp_path / "days"))
    want = summary.day_summary(summary.station_day(vd))
    names = ["date", "total_records", "peak_records", "offpeak_records", "unique_vd_count"]
    assert as_set(got.select(names)) == as_set(want.select(names))


def test_late_rows_are_set_aside_and_merged(spark, sf, tmp_path):
    base = str(tmp_path / "b")
    vd = views.readings(spark, sf)
    middle = vd.agg(F.expr("percentile_approx(unix_seconds(update_time), 0.5)")).first()[0]
    late = F.unix_seconds("update_time") <= middle
    sink = jobs.keep_bins(base)
    sink(vd.where(~late), 0)
    sink(vd.where(late), 1)
    sink(vd.where(late), 1)
    got = spark.read.parquet(f"{base}/bins")
    rounded = lambda df: df.select("region", "bin", F.round("vd_speed", 6).alias("s"), "vd_volume", F.round("vd_occupancy", 6).alias("o"))
    assert as_set(rounded(got)) == as_set(rounded(align.region_bins(vd)))
    assert spark.read.parquet(f"{base}/late").count() == vd.where(late).count()


def test_append_reads_the_keys_of_its_hours_only(spark, tmp_path):
    path = str(tmp_path / "lanes")
    rows = lane_rows(spark, 1200).select(
        F.to_date("update_time").alias("date"), "update_time", "vd_id", F.lit(1).alias("lane_id"), "speed"
    )
    sizes = []
    for i in range(10):  # two hours a batch
        at = F.unix_seconds("update_time") - 1_704_067_200
        batch = rows.where((at >= i * 7200) & (at < (i + 1) * 7200))
        if i:
            held = tables.stored_keys(spark, path, tables.LANE_KEY, batch.withColumn(tables.HOUR, F.hour("update_time")), True)
            sizes.append(held.count())
        tables.write_lane_days(batch.unionByName(batch.limit(20)), path)
    assert max(sizes) == 0  # nothing of earlier hours is read, however long the day is
    assert tables.load_days(spark, path).count() == rows.where(at < 72_000).count()
    tables.write_lane_days(rows, path)
    assert tables.load_days(spark, path).count() == 1200
    assert tables.HOUR not in tables.load_days(spark, path).columns


@pytest.mark.parametrize("tolerance", [3.0, 7.0, 20.0])
def test_wide_stream_alignment_is_part_of_the_batch_one(spark, sf, tmp_path, tolerance):
    events = views.table(spark, sf, "events").withColumn("_at", F.col("event_id"))
    vd = views.readings_of(live.ordered_batches(spark, events, "_at", 2))
    etag = views.tolls_of(live.ordered_batches(spark, events, "_at", 2))
    jobs.write_available(
        jobs.aligned(vd, etag, tolerance_min=tolerance), str(tmp_path / "out"), str(tmp_path / "check")
    )
    got = as_set(spark.read.parquet(str(tmp_path / "out")))
    want = as_set(align.align(views.readings(spark, sf), views.tolls(spark, sf), tolerance_min=tolerance))
    assert set(got) <= set(want) and len(got) >= len(want) - 10
