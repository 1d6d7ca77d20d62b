"""Feature projections of the fused table and of the station table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweave import constants as C
from roadweave.functions.rules import congestion, speed_level
from roadweave.functions.times import flag, fused_calendar, station_calendar
from roadweave.operators import series
from roadweave.session import materialize
from roadweave.streaming import history

FUSED_KEYS = ("date", "datetime", "region", "etag_pair", "vehicle_type_code", "flow_pos")
FUSED_TARGET = "speed_mean"
FUSED_REQUIRED = ("vd_speed", "vd_volume", "vd_occupancy", "etag_speed", "etag_volume")
FUSED_LAGGED = ("speed_mean", "vd_speed", "volume_mean")

# --- fixed value: columns every fused table has ----------------------------
FUSED_CORE = (
    "hour",
    "day_of_week",
    "is_weekend",
    "is_morning_peak",
    "is_evening_peak",
    "is_peak_hour",
    "hour_sin",
    "hour_cos",
    "speed_diff",
    "speed_diff_abs",
    "speed_diff_ratio",
    "speed_mean",
    "speed_max",
    "speed_min",
    "vd_speed_level",
    "etag_speed_level",
    "volume_diff",
    "volume_diff_abs",
    "volume_diff_ratio",
    "volume_mean",
    "volume_max",
    "vd_density",
    "etag_density",
    "density_ratio",
    "vd_congestion",
    "etag_congestion",
    "congestion_mean",
    "vd_efficiency",
    "etag_efficiency",
    "efficiency_ratio",
    "occupancy_speed_ratio",
    "occupancy_volume_ratio",
    "region_code",
    "is_yuanshan",
    "is_taipei",
    "is_sanchong",
    "speed_mean_lag_1",
    "vd_speed_lag_1",
    "volume_mean_lag_1",
    "speed_mean_lag_2",
    "vd_speed_lag_2",
    "volume_mean_lag_2",
)


def _per(top: Column, bottom: Column) -> Column:
    """Ratio with the +1 guard; null where the guarded divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double") + F.lit(1.0))


def _mean2(a: Column, b: Column) -> Column:
    return (a + b) / F.lit(2.0)


def _require(aligned: DataFrame) -> None:
    missing = [c for c in FUSED_REQUIRED if c not in aligned.columns]
    if missing:
        raise ValueError(f"aligned table lacks {missing}")


def fused_row_features(aligned: DataFrame) -> DataFrame:
    """All features of an aligned row that need no other row."""
    _require(aligned)
    v, e = F.col("vd_speed"), F.col("etag_speed")
    vol, cnt = F.col("vd_volume"), F.col("etag_volume")
    occ = F.col("vd_occupancy")
    region = F.col("region")
    first = {
        **fused_calendar(F.col("datetime")),
        "speed_diff": v - e,
        "speed_diff_abs": F.abs(v - e),
        "speed_diff_ratio": _per(v - e, e),
        "speed_mean": _mean2(v, e),
        "speed_max": F.greatest(v, e),
        "speed_min": F.least(v, e),
        "vd_speed_level": speed_level(v),
        "etag_speed_level": speed_level(e),
        "volume_diff": vol - cnt,
        "volume_diff_abs": F.abs(vol - cnt),
        "volume_diff_ratio": _per(vol - cnt, cnt),
        "volume_mean": _mean2(vol, cnt),
        "volume_max": F.greatest(vol, cnt.cast("long")),
        "vd_density": _per(vol, v),
        "etag_density": _per(cnt, e),
        "density_ratio": _per(_per(vol, v), _per(cnt, e)),
        "vd_congestion": congestion(v),
        "etag_congestion": congestion(e),
        "congestion_mean": _mean2(congestion(v), congestion(e)),
        "vd_efficiency": _per(v, vol),
        "etag_efficiency": _per(e, cnt),
        "efficiency_ratio": _per(_per(v, vol), _per(e, cnt)),
        "occupancy_speed_ratio": _per(occ, v),
        "occupancy_volume_ratio": _per(occ, vol),
        "region_code": F.coalesce(
            F.try_element_at(
                F.create_map(*[F.lit(x) for kv in C.REGION_CODES.items() for x in kv]), region
            ),
            F.lit(0),
        ),
        "is_yuanshan": flag(region == "圓山"),
        "is_taipei": flag(region == "台北"),
        "is_sanchong": flag(region == "三重"),
    }
    return aligned.withColumns(first)


def fused_features(
    aligned: DataFrame,
    by_vehicle: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """The 47 candidate features and the target.

    Lags run within a date and (region, pair), in (time, flow position) order, and
    are 0 where missing or where the date has at most two rows. ``by_vehicle``
    keeps vehicle types apart.
    """
    _require(aligned)
    # Only the lagged values go through the shuffle; the row features follow it.
    lean = aligned.withColumns(
        {
            "speed_mean": _mean2(F.col("vd_speed"), F.col("etag_speed")),
            "volume_mean": _mean2(F.col("vd_volume"), F.col("etag_volume")),
        }
    )
    keys = ["date", "region", "etag_pair"] + (["vehicle_type_code"] if by_vehicle else [])
    order = ["datetime", "flow_pos"]
    periods = (1, 2)
    lagged = series.lags(
        lean, keys, order, list(FUSED_LAGGED), periods, fill=0.0, parts=parts
    )
    # A day of at most two rows gets no lags at all. There is at most one such row
    # per calendar date.
    short = (
        aligned.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max(periods))
    )
    tagged = lagged.join(
        F.broadcast(short.select("date", F.lit(True).alias("_short"))), "date", "left"
    )
    names = [f"{t}_lag_{p}" for p in periods for t in FUSED_LAGGED]
    return fused_row_features(
        tagged.withColumns(
            {c: F.when(F.col("_short"), 0.0).otherwise(F.col(c)) for c in names}
        ).drop("_short")
    )


def complete_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Add every column of ``names`` that is missing, as 0.0."""
    absent = [c for c in names if c not in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in absent}) if absent else df


# --- station table ----------------------------------------------------------


def station_encoding(vd: DataFrame) -> DataFrame:
    """Alphabetical whole-number code for each detector id, as a dimension table."""
    ids = vd.select("vd_id").where(F.col("vd_id").isNotNull()).distinct()
    return number_sorted(ids, "vd_id", "vd_encoded")


def number_sorted(ids: DataFrame, column: str, code: str) -> DataFrame:
    """Number distinct strings 0.. in sorted order.

    The ids are dealt by ranges and ranked inside each; a range's offset comes from the
    ranges' sizes, of which there are as many as partitions.
    """
    dealt = ids.repartitionByRange(column).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt, "numbers")
    running = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("_p")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_o"))
    )
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return dealt.join(F.broadcast(offsets), "_p").select(
        column, (F.col("_o") + rank - 1).cast("int").alias(code)
    )


def station_columns(vd: DataFrame, encoding: DataFrame | None = None) -> DataFrame:
    """Station code (-1 when unseen) and the three place flags."""
    id_ = F.col("vd_id")
    if encoding is not None:
        vd = vd.join(encoding, "vd_id", "left").withColumn(
            "vd_encoded", F.coalesce("vd_encoded", F.lit(-1))
        )
    return vd.withColumns(
        {
            "is_yuanshan": flag(id_.rlike("圓山|23")),
            "is_taipei": flag(id_.rlike("台北|25")),
            "is_sanchong": flag(id_.rlike("三重|27")),
        }
    )


def interactions(df: DataFrame) -> DataFrame:
    """Speed, occupancy and volume products and shares, for the columns present."""
    have = set(df.columns)
    out: dict[str, Column] = {}
    if {"speed", "occupancy"} <= have:
        out["speed_occupancy_ratio"] = _per(F.col("speed"), F.col("occupancy"))
        out["speed_occupancy_product"] = (F.col("speed") * F.col("occupancy")).cast("double")
    if {"volume_total", "occupancy"} <= have:
        out["volume_density"] = _per(F.col("volume_total"), F.col("occupancy"))
    if {"volume_small", "volume_large", "volume_truck", "volume_total"} <= have:
        out["small_car_ratio"] = _per(F.col("volume_small"), F.col("volume_total"))
        out["large_car_ratio"] = _per(F.col("volume_large"), F.col("volume_total"))
        out["truck_ratio"] = _per(F.col("volume_truck"), F.col("volume_total"))
    if {"is_peak_hour", "volume_total"} <= have:
        out["peak_volume_interaction"] = F.col("is_peak_hour") * F.col("volume_total")
    return df.withColumns(out)


def station_features(
    vd: DataFrame | series.SeriesTable,
    keys: tuple[str, ...] = ("vd_id", "lane_id"),
    order: tuple[str, ...] = ("update_time",),
    targets: tuple[str, ...] = ("speed",),
    encoding: DataFrame | None = None,
    horizon: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Lag, rolling, calendar, station and interaction features.

    The windows come first, so their one shuffle carries the input columns only.
    Lags and rolling frames stay within a station lane. With ``horizon`` the label
    that many rows ahead is added.
    """
    wide = series.lags_and_rolling(
        vd, list(keys), list(order), list(targets), horizon=horizon, parts=parts
    )
    return station_row_features(wide, encoding)


def station_row_features(wide: DataFrame, encoding: DataFrame | None = None) -> DataFrame:
    """Calendar, station and interaction features, which need no other row."""
    wide = wide.withColumns(station_calendar(F.col("update_time")))
    return interactions(station_columns(wide, encoding))


def streamed_station_features(
    vd: DataFrame,
    keys: tuple[str, ...] = ("vd_id", "lane_id"),
    order: tuple[str, ...] = ("update_time",),
    targets: tuple[str, ...] = ("speed",),
    encoding: DataFrame | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """``station_features`` of a stream of detector rows.

    The state store keeps the last values of each lane; a row is given out once the watermark
    has passed it, with the features the batch gives it.
    """
    before = max(*series.PERIODS, max(series.WINDOWS) - 1)
    rows = history.with_history(vd, list(keys), list(order), list(targets), before, delay)
    return station_row_features(series.from_history(rows, list(targets)), encoding)


def numeric_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


