"""Public entry points: ingest, clean, align, fuse, train, forecast, analyse.

Stages hand over partitioned tables, as day folders do; every stage handles all
dates in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave import constants as C
from roadweave.functions.rules import traffic_status
from roadweave.operators import align as al
from roadweave.operators import clean as cl
from roadweave.operators import features as ft
from roadweave.operators import metrics, models, profile, select, series, split, summary
from roadweave.session import materialize
from roadweave.sources import documents, tables
from roadweave.streaming import jobs


@dataclass(frozen=True)
class Store:
    """Where the stages keep their tables."""

    base: str

    def path(self, *parts: str) -> str:
        return "/".join([self.base.rstrip("/"), *parts])

    @property
    def raw_vd(self) -> str:
        return self.path("raw", "vd")

    @property
    def raw_etag(self) -> str:
        return self.path("raw", "etag")

    @property
    def lanes(self) -> str:
        return self.path("processed", "vd")

    @property
    def flows(self) -> str:
        return self.path("processed", "etag")

    @property
    def cleaned(self) -> str:
        return self.path("cleaned")

    @property
    def aligned(self) -> str:
        return self.path("processed", "aligned")

    @property
    def fused(self) -> str:
        return self.path("processed", "fused")

    @property
    def ledger(self) -> str:
        return self.path("ledger", "vd")

    @property
    def models(self) -> str:
        return self.path("models")


# --- ingest -----------------------------------------------------------------


def process_target_route_data(spark: SparkSession, store: Store, max_files: int | None = None) -> DataFrame:
    """Ingest new detector files and return the lane table."""
    if tables.exists(spark, store.raw_vd):
        jobs.ingest_vd(
            spark,
            store.raw_vd,
            store.lanes,
            store.path("checkpoints", "vd"),
            max_files,
            store.path("archive", "vd"),
            store.ledger,
        )
    return load_target_route_data(spark, store)


def load_target_route_data(spark: SparkSession, store: Store, date: str | None = None) -> DataFrame:
    return tables.load_days(spark, store.lanes, date, tables.LANE_SCHEMA)


def process_etag_data(spark: SparkSession, store: Store, max_files: int | None = None) -> DataFrame:
    """Ingest new gantry files and return the flow table."""
    jobs.ingest_etag(
        spark, store.raw_etag, store.flows, store.path("checkpoints", "etag"), max_files
    )
    return tables.load_days(spark, store.flows)


def get_etag_summary(spark: SparkSession, store: Store) -> DataFrame:
    return summary.gantry_day_summary(tables.load_days(spark, store.flows))


def check_system_readiness(spark: SparkSession, store: Store) -> DataFrame:
    """Pending files, stored dates and what to do next."""
    if tables.exists(spark, store.raw_vd):
        names = documents.vd_documents(spark, store.raw_vd).select("file_name")
        done = tables.load_days(spark, store.ledger, empty="archived_name string")
        pending = documents.pending_files(names, done)
    else:
        pending = spark.createDataFrame([], "file_name string")
    return profile.next_action(
        pending, tables.available_dates(load_target_route_data(spark, store))
    )


def auto_process_data(spark: SparkSession, store: Store) -> DataFrame:
    """Ingest when files are pending; return the readiness row from before."""
    state = check_system_readiness(spark, store).first()
    if state["next_action"] == "process_raw_files":
        process_target_route_data(spark, store)
    return spark.createDataFrame([state])


# --- clean ------------------------------------------------------------------


def clean_all_target_data(spark: SparkSession, store: Store, method: str = "mark_nan") -> DataFrame:
    """Clean every stored day and return the report per date and time category."""
    raw = cl.normalize_types(tables.load_days(spark, store.lanes))
    tables.write_days(cl.clean(raw, method), store.cleaned, ("date", "time_category"))
    return cl.clean_report(raw, ["date", "time_category"], method)


def get_cleaning_summary(spark: SparkSession, store: Store) -> DataFrame:
    return tables.store_files(spark, store.cleaned)


def load_cleaned_data(spark: SparkSession, store: Store, date: str | None = None) -> DataFrame:
    """A cleaned day; the newest one when no date is given."""
    df = tables.load_days(spark, store.cleaned, date)
    return tables.newest_day(df) if date is None else df


def load_vd(spark: SparkSession, store: Store) -> DataFrame:
    """Cleaned days where there are any, else the lanes as ingested."""
    raw = load_target_route_data(spark, store)
    if not tables.exists(spark, store.cleaned):
        return raw
    return tables.prefer(tables.load_days(spark, store.cleaned), raw)


# --- align and fuse ---------------------------------------------------------


def get_available_data_status(spark: SparkSession, store: Store) -> DataFrame:
    """Dates of either feed and whether both have them."""
    vd = tables.available_dates(load_vd(spark, store)).withColumn("v", F.lit(1))
    et = tables.available_dates(tables.load_days(spark, store.flows)).withColumn("e", F.lit(1))
    return vd.join(et, "date", "full").select(
        "date",
        F.coalesce("v", F.lit(0)).alias("has_vd"),
        F.coalesce("e", F.lit(0)).alias("has_etag"),
        (F.col("v").isNotNull() & F.col("e").isNotNull()).cast("int").alias("is_common"),
    )


def align_all_available_data(
    spark: SparkSession, store: Store, tolerance_min: float = 2.0
) -> DataFrame:
    """Align all common dates, store the table, return the summary per date."""
    joined = al.align(load_vd(spark, store), tables.load_days(spark, store.flows), tolerance_min)
    tables.write_days(joined, store.aligned)
    return al.alignment_summary(tables.load_days(spark, store.aligned), ["date"], tolerance_min)


def process_all_fusion_data(
    spark: SparkSession, store: Store, target: str = ft.FUSED_TARGET, k: int = 15
) -> DataFrame:
    """Features for all dates, selection and scaling frozen on the first, quality per date."""
    wide = ft.fused_features(tables.load_days(spark, store.aligned))
    frozen = select.fit_on_first_day(wide, target, k)
    frozen.save(spark, store.path("models", "fusion_features"))
    tables.write_days(frozen.transform(wide), store.fused)
    stored = tables.load_days(spark, store.fused)
    return select.fused_quality(stored, list(frozen.names), target, ["date"])


def get_fusion_data_status(spark: SparkSession, store: Store) -> DataFrame:
    return al.coverage(
        tables.load_days(spark, store.aligned), tables.load_days(spark, store.fused)
    )


# --- train and forecast -----------------------------------------------------


def with_label(
    df: DataFrame,
    target: str,
    minutes: int,
    keys: tuple[str, ...] = ("region", "etag_pair", "vehicle_type_code"),
    time: str = "datetime",
    first: tuple[str, ...] = ("flow_pos",),
) -> tuple[DataFrame, str]:
    """The label to learn: ``target`` itself (0 minutes), or its value so many minutes later
    for the same key. Rows without one cannot be learned from."""
    if minutes == 0:
        return df, target
    label = f"{target}_in_{minutes}_min"
    out = series.later(df, list(keys), time, target, minutes, list(first), label)
    return out.where(F.col(label).isNotNull()), label


def train_enhanced_predictor(
    spark: SparkSession,
    store: Store,
    sample_rate: float = 1.0,
    test_size: float = 0.2,
    minutes: int = 15,
    gbt: dict | None = None,
    forest: dict | None = None,
) -> DataFrame:
    """Train both regressors on the fused table, store them, return the metric table.

    The label is the speed ``minutes`` later, by time. ``minutes=0`` learns the same row's
    speed, which the features contain; its R2 is no forecast quality.
    """
    target = ft.FUSED_TARGET
    fused = tables.load_days(spark, store.fused)
    fused = split.sample_exact(
        fused, "date", ["datetime", "region", "etag_pair", "flow_pos"], sample_rate
    )
    labelled, label = with_label(fused, target, minutes)
    features = [
        c for c in select.candidates(labelled, label) if minutes > 0 or c != target
    ]
    # read several times by the split and the trainers, so written once
    filled = materialize(select.fill_for_model(labelled, features, label), "fused-rows")
    tie = filled.withColumn("_tie", F.shiftright(F.xxhash64("region", "etag_pair", "flow_pos"), 2))
    marked = split.chronological_split(tie, "datetime", "_tie", 1.0 - test_size).drop("_tie")
    models.require_rows(marked)
    train_df, test_df = marked.where("is_train = 1"), marked.where("is_train = 0")
    frozen = select.fit_scaler(train_df, features, label)
    keys = ("date", "datetime", "region", "etag_pair", "flow_pos")
    model, scored = models.train_and_score(
        frozen.transform(train_df, keys),
        frozen.transform(test_df, keys),
        frozen.names,
        label,
        gbt,
        forest,
    )
    models.save(
        spark, store.models, model, frozen, {"target": target, "label": label, "minutes": minutes}
    )
    return scored


def load_enhanced_predictor(spark: SparkSession, store: Store):
    """(pipeline, frozen features, settings) as trained."""
    return models.load(spark, store.models)


def predict_15_minutes(spark: SparkSession, store: Store, fused: DataFrame) -> DataFrame:
    """Forecast from the newest row of every (region, pair), all at once."""
    model, frozen, _ = load_enhanced_predictor(spark, store)
    keys = ("region", "etag_pair", "datetime")
    newest = series.latest(fused, ["region", "etag_pair"], ["datetime", "flow_pos"])
    scored = models.score(model, frozen, newest, keys)
    return scored.withColumn("traffic_status", traffic_status(F.col("ensemble")))


def evaluate_models(spark: SparkSession, store: Store, labelled: DataFrame) -> DataFrame:
    """Metrics of the stored models on new, labelled rows."""
    model, frozen, config = load_enhanced_predictor(spark, store)
    return models.evaluate(
        model, frozen.transform(labelled, ("datetime",)), config["label"]
    )


def train_traffic_prediction_system(
    spark: SparkSession,
    store: Store,
    minutes: int = 15,
    gbt: dict | None = None,
    forest: dict | None = None,
) -> DataFrame:
    """The station-level models: detector features, chronological split, metrics.

    The label is the lane's speed ``minutes`` later; snapshots are told apart by the minute.
    ``minutes=0`` learns the same row's speed, as the fused models do.
    """
    vd = load_vd(spark, store)
    keys, target = ("vd_id", "lane_id"), "speed"
    encoding = ft.station_encoding(vd)
    wide = ft.station_features(vd, keys, encoding=encoding)
    minute = wide.withColumn("_minute", F.date_trunc("minute", "update_time"))
    wide, label = with_label(minute, target, minutes, keys, "_minute", ("update_time",))
    rows = materialize(wide.drop("_minute").na.drop(), "station-rows")
    models.require_rows(rows)
    features = [
        c
        for c in ft.numeric_columns(rows, ["lane_id", label])
        if c != target or minutes
    ]
    tie = rows.withColumn("_tie", F.shiftright(F.xxhash64(*keys), 2))
    marked = split.chronological_split(tie, "update_time", "_tie").drop("_tie")
    train_df, test_df = marked.where("is_train = 1"), marked.where("is_train = 0")
    frozen = select.fit_scaler(train_df, features, label)
    keep = (*keys, "update_time")
    model, scored = models.train_and_score(
        frozen.transform(train_df, keep),
        frozen.transform(test_df, keep),
        frozen.names,
        label,
        gbt or models.STATION_GBT,
        forest or models.STATION_FOREST,
    )
    encoding.write.mode("overwrite").parquet(store.path("models", "station_encoding"))
    models.save(
        spark,
        store.path("models", "station"),
        model,
        frozen,
        {"target": target, "label": label, "minutes": minutes},
    )
    return scored


def predict_stations(spark: SparkSession, store: Store, recent: DataFrame) -> DataFrame:
    """Forecast per station lane from its recent rows (at least the last 13)."""
    path = store.path("models", "station")
    model, frozen, config = models.load(spark, path)
    encoding = spark.read.parquet(store.path("models", "station_encoding"))
    keys = ("vd_id", "lane_id", "update_time")
    wide = ft.station_features(recent, encoding=encoding, horizon=0)
    newest = series.latest(wide, ["vd_id", "lane_id"], ["update_time"])
    scored = models.score(model, frozen, newest, keys).select(*keys, "gbt", "random_forest")
    weights = {k: C.STATION_CONFIDENCE[k] for k in ("gbt", "random_forest")}
    return metrics.blend_by_confidence(scored, weights)


# --- analyse ----------------------------------------------------------------


def quick_analyze(
    spark: SparkSession, store: Store, sample_rate: float = 1.0, out: str | None = None
) -> DataFrame:
    """The full report as one JSON document, optionally stored."""
    vd = tables.load_days(spark, store.cleaned)
    vd = split.sample_exact(vd, "date", ["vd_id", "lane_id", "update_time"], sample_rate)
    rollup_path = store.path("reports", "station_day")
    summary.station_day(vd).write.mode("overwrite").parquet(rollup_path)
    doc = summary.to_json_report(profile.report(spark.read.parquet(rollup_path)))
    if out:
        tables.write_json_report(doc, out)
    return doc
