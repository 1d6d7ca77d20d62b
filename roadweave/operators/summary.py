"""Per-day, per-pair and whole-store summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave import constants as C
from roadweave.functions.times import is_peak_label, time_category

MEASURES = (
    "speed",
    "volume_total",
    "occupancy",
    "volume_small",
    "volume_large",
    "volume_truck",
)


def with_peak(vd: DataFrame) -> DataFrame:
    label = (
        F.col("time_category") if "time_category" in vd.columns else time_category(F.col("update_time"))
    )
    return vd.withColumn("is_peak", is_peak_label(label))


def station_day(vd: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Roll the lane table up to (date, station, peak) once.

    All profile, readiness, day and chart figures are read off this small table:
    one scan, partial sums before the shuffle, distinct stations and dates counted
    on rolled-up rows. It can also be stored and extended day by day.
    """
    counted = columns or vd.columns
    vd = with_peak(vd)
    cells: Column = F.lit(0)
    for c in counted:
        cells = cells + F.col(c).isNotNull().cast("int")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(cells).cast("long").alias("cells")]
    for m in MEASURES:
        if m in vd.columns:
            aggs += [F.sum(F.col(m).cast("double")).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n")]
    aggs += [F.min("update_time").alias("first_time"), F.max("update_time").alias("last_time")]
    return (
        vd.groupBy("date", "vd_id", "is_peak")
        .agg(*aggs)
        .withColumn("n_columns", F.lit(len(counted)))
    )


def mean_of(measure: str) -> Column:
    return F.try_divide(F.sum(f"{measure}_sum"), F.sum(f"{measure}_n"))


def day_summary(rollup: DataFrame) -> DataFrame:
    """One row per date: rows, peak and off-peak rows, means, distinct stations."""
    return rollup.groupBy("date").agg(
        F.sum("n").alias("total_records"),
        F.sum(F.when(F.col("is_peak"), F.col("n")).otherwise(0)).alias("peak_records"),
        F.sum(F.when(~F.col("is_peak"), F.col("n")).otherwise(0)).alias("offpeak_records"),
        mean_of("speed").alias("avg_speed"),
        mean_of("volume_total").alias("avg_volume"),
        F.countDistinct("vd_id").alias("unique_vd_count"),
    )


def store_summary(days: DataFrame) -> DataFrame:
    """Roll-up of the day summaries."""
    return days.agg(
        F.count(F.lit(1)).alias("available_dates"),
        F.coalesce(F.sum("total_records"), F.lit(0)).alias("total_records"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    )


def peak_split(vd: DataFrame, peak: bool = True) -> DataFrame:
    marked = with_peak(vd)
    return marked.where(F.col("is_peak") if peak else ~F.col("is_peak")).drop("is_peak")


def vehicle_stats(etag: DataFrame) -> DataFrame:
    """Per pair and vehicle type: vehicles, mean travel time and speed, valid rows."""
    return etag.groupBy("etag_pair_id", "vehicle_type_name").agg(
        F.sum("vehicle_count").alias("vehicle_count"),
        F.avg("travel_time_seconds").alias("travel_time_seconds"),
        F.avg("space_mean_speed_kmh").alias("space_mean_speed_kmh"),
        F.sum("data_valid").alias("data_valid"),
    )


def pair_stats(etag: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, vehicles, valid rows and covered hours per pair (and day)."""
    span = F.unix_micros(F.max("update_time").cast("timestamp")) - F.unix_micros(
        F.min("update_time").cast("timestamp")
    )
    return etag.groupBy(*(by or []), "etag_pair_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("vehicle_count").alias("vehicle_count"),
        F.sum("data_valid").alias("data_valid"),
        F.min("update_time").alias("start_time"),
        F.max("update_time").alias("end_time"),
        (span / F.lit(3_600_000_000.0)).alias("span_hours"),
    )


def gantry_day_summary(etag: DataFrame) -> DataFrame:
    """One row per date with validity, time range, vehicle-type and pair figures.

    Fine (date, pair, type) counts come from one aggregation; totals and maps are
    built from grouping sets over those few rows.
    """
    fine = (
        etag.withColumn("date", F.to_date("update_time"))
        .groupBy("date", "etag_pair_id", "vehicle_type_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("data_valid").alias("valid"),
            F.sum("vehicle_count").alias("vehicles"),
            F.min("update_time").alias("t0"),
            F.max("update_time").alias("t1"),
        )
    )
    keys = ["date", "etag_pair_id", "vehicle_type_name"]
    sets = fine.groupingSets([["date", "etag_pair_id"], ["date", "vehicle_type_name"]], *keys).agg(
        F.grouping("etag_pair_id").alias("by_type"),
        F.sum("n").alias("n"),
        F.sum("valid").alias("valid"),
        F.sum("vehicles").alias("vehicles"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
    )
    pair, kind = F.col("by_type") == 0, F.col("by_type") == 1

    def total(c: str) -> Column:
        return F.sum(F.when(pair, F.col(c)))

    def as_map(rows: Column, key: str, value: str) -> Column:
        return F.map_from_entries(
            F.sort_array(F.collect_list(F.when(rows, F.struct(key, value))))
        )

    span = F.unix_micros(F.max("t1").cast("timestamp")) - F.unix_micros(F.min("t0").cast("timestamp"))
    return sets.groupBy("date").agg(
        total("n").alias("total_records"),
        total("valid").alias("valid_records"),
        (total("valid") * 100.0 / total("n")).alias("validity_rate"),
        F.count_if(pair).alias("unique_pairs"),
        F.min("t0").alias("start_time"),
        F.max("t1").alias("end_time"),
        (span / F.lit(3_600_000_000.0)).alias("span_hours"),
        as_map(kind, "vehicle_type_name", "n").alias("vehicle_type_distribution"),
        as_map(pair, "etag_pair_id", "vehicles").alias("pair_vehicle_count"),
        as_map(pair, "etag_pair_id", "valid").alias("pair_data_valid"),
    )


def gantry_store_summary(days: DataFrame) -> DataFrame:
    return days.agg(
        F.count(F.lit(1)).alias("processed_dates"),
        F.coalesce(F.sum("total_records"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("valid_records"), F.lit(0)).alias("valid_records"),
    )


def _pair_lookup() -> Column:
    entries = []
    for pair, segment, km, side in C.GANTRY_PAIRS:
        info = F.struct(
            F.lit(segment).alias("segment_name"),
            F.lit(side).alias("direction"),
            F.lit(km).alias("distance_km"),
        )
        entries += [F.lit(pair), info]
    return F.create_map(*entries)


def with_pair_info(etag: DataFrame, targets_only: bool = True) -> DataFrame:
    """Attach segment, direction and distance; other pairs are dropped or left null.

    The four pairs are a literal lookup, so there is no join and the pair filter
    reaches the scan.
    """
    if targets_only:
        etag = etag.where(F.col("etag_pair_id").isin(*[p[0] for p in C.GANTRY_PAIRS]))
    return etag.withColumn("_pair", F.try_element_at(_pair_lookup(), F.col("etag_pair_id"))).select(
        *etag.columns, "_pair.segment_name", "_pair.direction", "_pair.distance_km"
    )


def valid_flows(etag: DataFrame) -> DataFrame:
    return etag.where(F.col("data_valid") == 1)


def to_json_report(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
