import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from roadweave import constants as C
from roadweave.operators import align, clean, features, metrics, profile, select, summary
from roadweave.operators.moments import moments
from roadweave.registry import views
from roadweave.sources import tables

T0 = dt.datetime(2024, 1, 1, 10, 0)


def cells(spark, values, column="speed"):
    return spark.createDataFrame([(v,) for v in values], f"{column} double")


EDGE = [0.0, 150.0, 151.0, -1.0, -99.0, 999.0, 9999.0, None, math.nan, math.inf, -math.inf]


def test_cleaning_edges(spark):
    df = cells(spark, EDGE)
    marked = [r["speed"] for r in clean.mark_null(df).collect()]
    assert marked == [0.0, 150.0] + [None] * 9
    assert [r["speed"] for r in clean.drop_bad_rows(df).collect()] == [0.0, 150.0]
    row = clean.violations(df).first()
    assert (row["markers"], row["out_of_range"], row["missing"]) == (6, 7, 2)
    assert (row["rule_total"], row["bad_cells"]) == (15, 9)


def test_clean_report_counts(spark):
    df = cells(spark, EDGE).withColumn("date", F.lit("2024-01-01").cast("date"))
    keep = clean.clean_report(df, ["date"], "mark_nan").first()
    assert (keep["original_records"], keep["removed_records"]) == (11, 0)
    drop = clean.clean_report(df, ["date"], "remove_rows").first()
    assert (drop["cleaned_records"], drop["removed_records"]) == (2, 9)
    with pytest.raises(ValueError):
        clean.clean(df, "other")


def test_normalize_types(spark):
    df = spark.createDataFrame(
        [("7", "2024-01-01 00:00:00"), ("x", "soon"), ("NaN", None)], "speed string, update_time string"
    )
    rows = clean.normalize_types(df).collect()
    assert [r["speed"] for r in rows] == [7.0, None, None]
    assert rows[1]["update_time"] is None


def small_feeds(spark):
    def at(minute, second=0):
        return T0 + dt.timedelta(minutes=minute, seconds=second)

    vd = spark.createDataFrame(
        [
            (at(0), "VD-N1-N-23-圓山", 60.0, 10, 5.0),
            (at(4), "VD-N1-S-23-圓山", 80.0, 20, 15.0),
            (at(10), "VD-N1-N-25-台北", None, None, None),
        ],
        "update_time timestamp, vd_id string, speed double, volume_total int, occupancy double",
    )
    pair = "01F0017N-01F0005N"
    etag = spark.createDataFrame(
        [
            (at(2), pair, 90.0, 4, "31", 1),  # 2 min: kept
            (at(3), pair, 90.0, 4, "31", 2),  # nearest is the empty 10:05 bin
            (at(9), pair, None, None, "31", 3),  # 台北 10:10 bin at 1 min
            (at(2), "01F0029N-01F0017N", 70.0, 2, "31", 4),  # serves 台北 and 三重 only
        ],
        "update_time timestamp, etag_pair_id string, space_mean_speed_kmh double, vehicle_count int,"
        " vehicle_type_code string, flow_pos long",
    )
    return vd, etag


@pytest.mark.parametrize("tolerance", [2.0, 2.6])
def test_align_edges(spark, tolerance):
    out = {r["flow_pos"]: r for r in align.align(*small_feeds(spark), tolerance).collect()}
    assert set(out) == {1, 3}
    assert (out[1]["region"], out[1]["vd_speed"], out[1]["vd_volume"]) == ("圓山", 70.0, 30)
    assert out[1]["time_diff_min"] == 2.0
    assert (out[3]["region"], out[3]["vd_speed"], out[3]["etag_speed"], out[3]["etag_volume"]) == (
        "台北",
        0.0,
        0.0,
        0,
    )


def test_align_options(spark):
    vd, etag = small_feeds(spark)
    kept = {r["flow_pos"]: r for r in align.align(vd, etag, keep_null=True).collect()}
    assert kept[3]["vd_speed"] is None
    north = {r["flow_pos"]: r for r in align.align(vd, etag, split_direction=True).collect()}
    assert north[1]["vd_speed"] == 60.0


def test_alignment_does_not_cross_midnight(spark):
    vd = spark.createDataFrame(
        [(dt.datetime(2024, 1, 2, 0, 0), "台北", 50.0, 1, 1.0)],
        "update_time timestamp, vd_id string, speed double, volume_total int, occupancy double",
    )
    etag = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 23, 59), "01F0017N-01F0005N", 1.0, 1, "31", 1)],
        "update_time timestamp, etag_pair_id string, space_mean_speed_kmh double, vehicle_count int,"
        " vehicle_type_code string, flow_pos long",
    )
    assert align.align(vd, etag).count() == 0
    assert align.align(vd, etag, 3.0).count() == 0


def test_constant_correlation_is_null(spark):
    out = align.align(*small_feeds(spark)).where("flow_pos = 1")
    row = align.alignment_summary(out).first()
    assert row["speed_correlation"] is None and row["quality_score"] == 70.0


def fused_input(spark, rows):
    return spark.createDataFrame(
        rows,
        "date date, datetime timestamp, region string, etag_pair string, vd_speed double, vd_volume long,"
        " vd_occupancy double, etag_speed double, etag_volume int, flow_pos long",
    )


def test_fused_lags_reset_and_short_days(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    rows = [
        (d, dt.datetime.combine(d, dt.time(8, 5 * i)), "台北", "p", 10.0 * (i + 1), 1, 1.0, 10.0, 1, i)
        for d, n in ((d1, 3), (d2, 2))
        for i in range(n)
    ]
    out = {
        (r["date"], r["flow_pos"]): r for r in features.fused_features(fused_input(spark, rows)).collect()
    }
    assert [out[d1, i]["vd_speed_lag_1"] for i in range(3)] == [0.0, 10.0, 20.0]
    assert [out[d1, i]["vd_speed_lag_2"] for i in range(3)] == [0.0, 0.0, 10.0]
    assert [out[d2, i]["vd_speed_lag_1"] for i in range(2)] == [0.0, 0.0]
    assert out[d1, 0]["region_code"] == 2 and out[d1, 0]["is_peak_hour"] == 1


def test_fused_needs_its_columns(spark):
    with pytest.raises(ValueError):
        features.fused_row_features(spark.range(1))


def test_fused_has_47_features(spark):
    rows = [(dt.date(2024, 1, 1), T0, "台北", "p", 10.0, 1, 1.0, 10.0, 1, 0)]
    wide = features.fused_features(fused_input(spark, rows))
    # 46 candidates and the target; the remaining passthrough is the time difference
    assert len(select.candidates(wide, "speed_mean")) == 46
    assert set(features.FUSED_CORE) <= set(wide.columns)


def test_uncorrelated_uses_all_earlier_columns():
    nan = float("nan")
    m = [[1, 0.99, 0.1, nan], [0.99, 1, 0.97, nan], [0.1, 0.97, 1, nan], [nan, nan, nan, 1]]
    assert select.uncorrelated(list("abcd"), m) == ["a", "d"]


def test_k_best_and_scaling(spark):
    df = spark.range(200).select(
        F.col("id").cast("double").alias("y"),
        (F.col("id") * 2 + F.col("id") % 7).cast("double").alias("near"),
        (F.col("id") % 3).cast("double").alias("weak"),
        F.lit(4.0).alias("const"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("half"),
    )
    names = ["weak", "near", "const", "half"]
    assert select.k_best(moments(df, names, "y"), names, 2) == ["near", "half"]
    frozen = select.fit_scaler(df, ["near", "const"], "y")
    assert frozen.sds[1] == 1.0
    out = frozen.transform(df, ()).agg(F.avg("near"), F.stddev_pop("near"), F.avg("const")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1) and out[2] == 0
    # a table without the column counts it as 0
    part = frozen.transform(df.drop("near"), ()).first()
    assert part["near"] == pytest.approx(-frozen.means[0] / frozen.sds[0])


def test_selection_errors(spark):
    with pytest.raises(ValueError):
        select.candidates(spark.range(1), "speed_mean")
    with pytest.raises(ValueError):
        select.candidates(spark.range(1).select(F.lit(1.0).alias("speed_mean")), "speed_mean")


def test_frozen_features_round_trip(spark, tmp_path):
    frozen = select.FrozenFeatures("y", ("a", "b"), (1.0, 2.0), (3.0, 4.0))
    frozen.save(spark, str(tmp_path / "f"))
    assert select.FrozenFeatures.load(spark, str(tmp_path / "f")) == frozen


def test_metrics_known_values(spark):
    df = spark.createDataFrame(
        [(10.0, 11.0, None), (20.0, 18.0, 20.0), (30.0, 33.0, 30.0)], "y double, a double, b double"
    )
    rows = {r["model"]: r for r in metrics.model_metrics(df, "y", ["a", "b"]).collect()}
    assert rows["a"]["rmse"] == pytest.approx(math.sqrt(14 / 3))
    assert rows["a"]["mae"] == pytest.approx(2.0)
    assert rows["a"]["r2"] == pytest.approx(1 - 14 / 200)
    assert rows["a"]["mape"] == pytest.approx(10.0)
    assert rows["b"]["n"] == 2 and rows["b"]["r2"] == 1.0


def test_blend_falls_back_to_mean(spark):
    df = spark.createDataFrame([(1.0, 9.0, 7.0), (2.0, -9.0, 5.0)], "y double, a double, b double")
    out = [r["ensemble"] for r in metrics.blend_by_r2(df, "y", "a", "b").orderBy("y").collect()]
    assert out == [8.0, -2.0]


def test_confidence_blend_skips_missing(spark):
    df = spark.createDataFrame([(90.0, None), (None, None), (40.0, 60.0)], "a double, b double")
    out = metrics.blend_by_confidence(df, {"a": 85, "b": 80}).collect()
    assert (out[0]["predicted_speed"], out[0]["confidence"], out[0]["models_used"]) == (90.0, 85, 1)
    assert out[1]["predicted_speed"] is None and out[1]["traffic_status"] is None
    assert out[2]["predicted_speed"] == 49.7 and out[2]["traffic_status"] == "擁堵🔴"


def test_profile_of_empty_table(spark, sf):
    rollup = summary.station_day(views.readings(spark, sf).limit(0))
    ready = profile.readiness(profile.facts(rollup))
    row = ready.first()
    assert (row["total_records"], row["lstm_ready"], row["prediction_score"]) == (0, 0, 50.0)
    assert profile.recommendations(ready).count() == 0
    assert profile.kpis(ready).first()["top_model"] == "無推薦"
    assert profile.next_action(rollup, rollup.select("date")).first()["next_action"] == "add_raw_files"


def test_profile_counts_once_or_per_dataset(spark, sf):
    vd = views.readings(spark, sf)
    rollup = summary.station_day(vd)
    n = vd.count()
    assert profile.time_coverage(profile.facts(rollup)).first()["total_records"] == 2 * n
    assert profile.time_coverage(profile.facts(rollup, compatible=False)).first()["total_records"] == n


def test_day_table_round_trip(spark, sf, tmp_path):
    vd = views.readings(spark, sf)
    path = str(tmp_path / "t")
    tables.write_days(vd, path)
    one = vd.where("date = date '2024-01-03'")
    tables.write_days(one.where("speed > 50"), path)  # replaces that day only
    back = tables.load_days(spark, path)
    assert back.count() == vd.count() - one.where("speed <= 50").count()
    plan = tables.load_days(spark, path, "2024-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    files = tables.store_files(spark, path)
    assert files.agg(F.sum("records")).first()[0] == back.count()
    assert files.count() == vd.select("date").distinct().count()


def test_route_constants_are_consistent():
    pairs = {p[0] for p in C.GANTRY_PAIRS}
    assert {p for ps in C.REGION_PAIRS.values() for p in ps} == pairs
    assert sum(len(p) for p in C.REGION_PAIRS.values()) == 8
