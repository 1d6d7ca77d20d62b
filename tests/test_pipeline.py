import pytest
from pyspark.sql import functions as F

from roadweave.functions.times import time_category
from roadweave.operators import features as ft
from roadweave.operators import models, select
from roadweave.plans import pipeline
from roadweave.registry import views
from roadweave.sources import tables

GBT = {"maxIter": 3, "maxDepth": 3}
FOREST = {"numTrees": 4, "maxDepth": 4}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A store with four days of both feeds, dense enough to align."""
    made = pipeline.Store(str(tmp_path_factory.mktemp("store")))
    slot = spark.range(4 * 1440 // 5).select(
        F.timestamp_seconds(F.lit(1750464000) + F.col("id") * 300).alias("t0"), F.col("id").alias("i")
    )
    places = F.explode(F.array(F.lit("圓山"), F.lit("台北"), F.lit("三重"))).alias("place")
    wave = F.lit(70) + F.sin(F.col("i") / 12.0) * 25
    vd = slot.select("t0", "i", wave.alias("w"), places).select(
        F.to_date("t0").alias("date"),
        (F.col("t0") + F.expr("INTERVAL 1 MINUTE")).alias("update_time"),
        F.concat(F.lit("VD-N1-N-25-"), "place").alias("vd_id"),
        F.lit(0).alias("lane_id"),
        F.lit(1).alias("lane_type"),
        F.when(F.col("i") % 50 == 49, 999.0).otherwise(F.col("w")).alias("speed"),
        (F.col("i") % 30).cast("int").alias("occupancy"),
        (F.col("i") % 60).cast("int").alias("volume_total"),
        (F.col("i") % 40).cast("int").alias("volume_small"),
        (F.col("i") % 12).cast("int").alias("volume_large"),
        (F.col("i") % 8).cast("int").alias("volume_truck"),
        F.col("w").alias("speed_small"),
        F.col("w").alias("speed_large"),
        F.col("w").alias("speed_truck"),
    )
    tables.write_lane_days(
        vd.withColumn("time_category", time_category(F.col("update_time"))), made.lanes
    )
    pairs = F.explode(F.array(*[F.lit(p) for p in ("01F0017N-01F0005N", "01F0017S-01F0029S")]))
    etag = slot.select("t0", "i", wave.alias("w"), pairs.alias("etag_pair_id")).select(
        F.to_date("t0").alias("date"),
        F.col("t0").alias("update_time"),
        "etag_pair_id",
        F.lit("31").alias("vehicle_type_code"),
        (F.col("i") % 20).cast("int").alias("vehicle_count"),
        (F.col("w") + 3).alias("space_mean_speed_kmh"),
        F.col("i").alias("flow_pos"),
    )
    tables.write_days(etag, made.flows)
    return made


def test_whole_chain(spark, store):
    report = pipeline.clean_all_target_data(spark, store)
    assert report.agg(F.sum("invalid_values")).first()[0] > 0
    cleaned = pipeline.load_cleaned_data(spark, store)
    assert cleaned.select("date").distinct().count() == 1
    assert pipeline.load_vd(spark, store).where("speed > 150").count() == 0
    assert pipeline.get_cleaning_summary(spark, store).count() == 4
    status = pipeline.get_available_data_status(spark, store).collect()
    assert [r["is_common"] for r in status] == [1] * 4

    summary = pipeline.align_all_available_data(spark, store).collect()
    assert len(summary) == 4
    assert all(r["sync_quality_percent"] == 100.0 and r["speed_correlation"] > 0.5 for r in summary)

    quality = pipeline.process_all_fusion_data(spark, store).collect()
    assert len(quality) == 4 and all(0 < r["feature_count"] <= 15 for r in quality)
    assert all(r["quality_score"] >= 60 for r in quality)
    cover = pipeline.get_fusion_data_status(spark, store).collect()
    assert all(r["in_both"] == 1 and r["aligned_rows"] == r["fused_rows"] for r in cover)

    scored = {
        r["model"]: r
        for r in pipeline.train_enhanced_predictor(
            spark, store, minutes=15, gbt=GBT, forest=FOREST
        ).collect()
    }
    assert set(scored) == {"gbt", "random_forest", "ensemble"}
    assert scored["ensemble"]["r2"] > 0.5

    fused = tables.load_days(spark, store.fused)
    forecast = pipeline.predict_15_minutes(spark, store, fused).collect()
    assert len(forecast) == 4  # two pairs, each serving two regions
    assert all(0 < r["ensemble"] < 200 and r["confidence_ensemble"] == 92 for r in forecast)

    labelled, _ = pipeline.with_label(fused, "speed_mean", 15)
    assert pipeline.evaluate_models(spark, store, labelled).count() == 3

    leaky = pipeline.train_enhanced_predictor(
        spark, store, sample_rate=0.9, minutes=0, gbt=GBT, forest=FOREST
    )
    assert leaky.count() == 3


def test_station_models(spark, store):
    scored = pipeline.train_traffic_prediction_system(spark, store, gbt=GBT, forest=FOREST)
    assert scored.count() == 3
    recent = pipeline.load_target_route_data(spark, store, "2025-06-24")
    out = pipeline.predict_stations(spark, store, recent).collect()
    assert len(out) == 3 and all(r["confidence"] == 85 and r["models_used"] == 2 for r in out)


def test_analysis_report(spark, store, tmp_path):
    if not tables.exists(spark, store.cleaned):
        pipeline.clean_all_target_data(spark, store)
    doc = pipeline.quick_analyze(spark, store, out=str(tmp_path / "report"))
    text = doc.first()["report"]
    for part in ("data_summary", "quality_assessment", "time_coverage", "prediction_readiness",
                 "model_suitability", "recommendations", "key_insights", "actionable_recommendations"):
        assert part in text
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_stored_model_predicts_the_same(spark, tmp_path):
    df = spark.range(300).select(
        (F.col("id") % 17).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"),
        (F.col("id") % 17 * 3).cast("double").alias("y"),
    )
    frozen = select.fit_scaler(df, ["a", "b"], "y")
    model = models.train(frozen.transform(df, ()), ["a", "b"], "y", GBT, FOREST)
    models.save(spark, str(tmp_path / "m"), model, frozen, {"label": "y"})
    loaded, features, config = models.load(spark, str(tmp_path / "m"))
    assert config == {"label": "y"} and features == frozen
    one = models.score(model, frozen, df, ()).agg(F.sum("ensemble")).first()[0]
    two = models.score(loaded, features, df, ()).agg(F.sum("ensemble")).first()[0]
    assert one == pytest.approx(two, abs=1e-9)


def test_search_and_importances(spark):
    df = spark.range(200).select(
        (F.col("id") % 7).cast("double").alias("a"),
        F.rand(1).alias("noise"),
        (F.col("id") % 7 * 2).cast("double").alias("y"),
    )
    model, table = models.search(
        "random_forest", df, df, ["a", "noise"], "y",
        grid={"numTrees": [2, 3], "maxDepth": [1, 4]}, draws=2,
    )
    rows = table.collect()
    assert len(rows) == 2 and sum(r["is_best"] for r in rows) == 1
    fitted = models.train(df, ["a", "noise"], "y", GBT, FOREST)
    imp = {r["feature"]: r["importance"] for r in
           models.importances(spark, fitted, ["a", "noise"]).where("model = 'gbt'").collect()}
    assert imp["a"] > imp["noise"]


def test_too_little_data(spark):
    with pytest.raises(ValueError):
        models.require_rows(spark.range(999))
    assert models.require_rows(spark.range(1000)).count() == 1000


def test_station_encoding_marks_unseen(spark, sf):
    vd = views.readings(spark, sf)
    known = ft.station_encoding(vd.where("vd_id like 'VD-N1%'"))
    out = ft.station_columns(vd.select("vd_id"), known)
    assert out.where("vd_id not like 'VD-N1%' and vd_encoded <> -1").count() == 0
    codes = [r[0] for r in known.orderBy("vd_id").select("vd_encoded").collect()]
    assert codes == list(range(len(codes)))
