"""Joining the two feeds: regions, time bins and the nearest-time join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave import constants as C
from roadweave.functions.times import floor_bin


def with_region(vd: DataFrame, regions: tuple[str, ...] = tuple(C.REGION_PAIRS)) -> DataFrame:
    """One row per region whose name occurs in ``vd_id`` (a detector may match several)."""
    hits = F.array(*[F.when(F.col("vd_id").contains(r), r) for r in regions])
    return vd.withColumn("region", F.explode(hits)).where(F.col("region").isNotNull())


def region_bins(
    vd: DataFrame, minutes: int = C.BIN_MINUTES, split_direction: bool = False
) -> DataFrame:
    """Per region and time bin: mean speed, summed volume, mean occupancy.

    Lanes, stations and directions are pooled; ``split_direction`` keeps N and S
    apart. Partial sums are combined before the shuffle, so a busy region costs
    one row per bin and task.
    """
    keys: list[str | Column] = ["region"]
    if split_direction:
        keys.append(vd_direction(F.col("vd_id")).alias("direction"))
    return (
        with_region(vd)
        .where(F.col("update_time").isNotNull())
        .groupBy(*keys, floor_bin(F.col("update_time"), minutes).alias("bin"))
        .agg(
            F.avg("speed").alias("vd_speed"),
            F.sum("volume_total").alias("vd_volume"),
            F.avg("occupancy").alias("vd_occupancy"),
        )
    )


def vd_direction(vd_id: Column) -> Column:
    """``N`` or ``S`` as the third part of the detector id."""
    return F.try_element_at(F.split(vd_id, "-"), F.lit(3))


def regions_of_pair(pair: Column) -> Column:
    """Array of the regions a gantry pair serves; null for other pairs."""
    served: dict[str, list[str]] = {}
    for region, pairs in C.REGION_PAIRS.items():
        for p in pairs:
            served.setdefault(p, []).append(region)
    entries = []
    for p, regions in served.items():
        entries += [F.lit(p), F.array(*[F.lit(r) for r in regions])]
    return F.try_element_at(F.create_map(*entries), pair)


def pair_direction(pair: Column) -> Column:
    entries = [F.lit(x) for p in C.GANTRY_PAIRS for x in (p[0], p[3])]
    return F.try_element_at(F.create_map(*entries), pair)


def align(
    vd: DataFrame,
    etag: DataFrame,
    tolerance_min: float = C.SYNC_TOLERANCE_MIN,
    minutes: int = C.BIN_MINUTES,
    split_direction: bool = False,
    keep_null: bool = False,
) -> DataFrame:
    """Each gantry row with the nearest detector bin of every region it serves.

    A tolerance below half a bin leaves one candidate bin, the nearest one, so the
    as-of join is a plain equi join on (region, bin) plus a filter. Bins are built
    once per region. With wider tolerances a row has a few candidate bins, joined in
    the same way. (A right side off the grid needs :func:`nearest_join`.)
    """
    bins = region_bins(vd, minutes, split_direction)
    flows = gantry_side(etag)
    if split_direction:
        flows = flows.withColumn("direction", pair_direction(F.col("etag_pair_id")))
    if tolerance_min < minutes / 2:
        joined = nearest_bin_join(
            flows, bins, ["region"] + (["direction"] if split_direction else []), minutes
        )
    else:
        joined = candidate_bin_join(
            flows,
            bins,
            ["region"] + (["direction"] if split_direction else []),
            tolerance_min,
            minutes,
        )
    return finish_alignment(joined, tolerance_min, keep_null)


def gantry_side(etag: DataFrame) -> DataFrame:
    """Gantry rows repeated for each region their pair belongs to (at most two)."""
    extra = [c for c in ("vehicle_type_code", "flow_pos") if c in etag.columns]
    return etag.where(F.col("etag_pair_id").isin(*[p[0] for p in C.GANTRY_PAIRS])).select(
        F.col("update_time").alias("datetime"),
        F.explode(regions_of_pair(F.col("etag_pair_id"))).alias("region"),
        "etag_pair_id",
        F.col("space_mean_speed_kmh").alias("etag_speed"),
        F.col("vehicle_count").alias("etag_volume"),
        *extra,
    )


def nearest_bin_join(
    flows: DataFrame, bins: DataFrame, keys: list[str], minutes: int = C.BIN_MINUTES
) -> DataFrame:
    half = F.expr(f"INTERVAL {minutes * 30} SECONDS")
    near = flows.withColumn("bin", floor_bin(F.col("datetime").cast("timestamp") + half, minutes))
    return near.join(bins, [*keys, "bin"])


def with_candidates(flows: DataFrame, tolerance_min: float, minutes: int = C.BIN_MINUTES) -> DataFrame:
    """A row for each bin start of the flow's day within the tolerance, in the column bin."""
    step = minutes * 60_000_000
    at = F.unix_micros(F.col("datetime").cast("timestamp"))
    tol = F.lit(int(round(tolerance_min * 60_000_000)))
    grid = F.sequence(F.ceil((at - tol) / F.lit(step)).cast("long"), F.floor((at + tol) / F.lit(step)).cast("long"))
    return (
        flows.withColumn("bin", F.explode(grid))
        .withColumn("bin", F.timestamp_micros(F.col("bin") * F.lit(step)))
        .where(F.to_date("bin") == F.to_date("datetime"))
    )


def candidate_bin_join(
    flows: DataFrame, bins: DataFrame, keys: list[str], tolerance_min: float, minutes: int = C.BIN_MINUTES
) -> DataFrame:
    """The nearest bin of the same day within the tolerance, the earlier one of two.

    Bins lie on a grid, so a row is dealt to its 2 * tolerance / bin + 1 candidates at most
    and joined by equality; the nearest one found is picked per row.
    """
    near = with_candidates(flows.withColumn("_row", F.monotonically_increasing_id()), tolerance_min, minutes)
    joined = near.join(bins, [*keys, "bin"])
    gap = F.abs(F.unix_micros("bin") - F.unix_micros(F.col("datetime").cast("timestamp")))
    value = [c for c in joined.columns if c not in ("_row", "bin")]
    pick = F.min_by(F.struct("bin", *value), F.struct(gap, "bin"))
    return joined.groupBy("_row").agg(pick.alias("_r")).select("_r.*")


def finish_alignment(joined: DataFrame, tolerance_min: float, keep_null: bool) -> DataFrame:
    gap = F.abs(
        F.unix_micros(F.col("datetime").cast("timestamp")) - F.unix_micros(F.col("bin"))
    ) / F.lit(60_000_000.0)

    def value(c: str, zero) -> Column:
        return F.col(c) if keep_null else F.coalesce(F.col(c), zero)

    extra = [c for c in ("vehicle_type_code", "flow_pos", "direction") if c in joined.columns]
    return (
        joined.withColumn("time_diff_min", gap)
        .where(
            (F.col("time_diff_min") <= tolerance_min)
            & (F.to_date("datetime") == F.to_date("bin"))
        )
        .select(
            F.to_date("datetime").alias("date"),
            "datetime",
            "region",
            F.col("etag_pair_id").alias("etag_pair"),
            value("vd_speed", F.lit(0.0)).alias("vd_speed"),
            value("vd_volume", F.lit(0)).cast("long").alias("vd_volume"),
            value("vd_occupancy", F.lit(0.0)).alias("vd_occupancy"),
            F.coalesce("etag_speed", F.lit(0.0)).cast("double").alias("etag_speed"),
            F.coalesce("etag_volume", F.lit(0)).cast("int").alias("etag_volume"),
            "time_diff_min",
            *extra,
        )
    )


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    tolerance_sec: float,
    same_day: bool = False,
    spread: int = 8,
) -> DataFrame:
    """Each left row with the nearest right row of its key, before or after it.

    Rows further away than ``tolerance_sec`` do not match; the earlier right row
    wins a tie. No pairs are formed: both sides are put in one ordered stream per
    (key, time slice), and each left row reads the last right row before it and
    the first one after it. Slices are at least one tolerance wide, so besides its
    own rows a slice needs only the last right row of the slice before and the
    first of the slice after. Left rows are spread over ``spread`` sub-groups, with
    the right rows copied to each, so a hot key or instant is shared by tasks.
    Right rows must be unique per (key, time).
    """
    width = max(int(tolerance_sec) + 1, 600)
    tol = int(round(tolerance_sec * 1_000_000))

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    def slice_of(c: str) -> Column:
        return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / F.lit(width)).cast("long")

    packed = F.struct(micros(right_ts).alias("t"), F.col(right_ts), *values)
    r = right.select(
        *keys, slice_of(right_ts).alias("_slice"), packed.alias("_right")
    )
    if same_day:
        r = r.withColumn("_day", F.to_date(f"_right.{right_ts}"))
    else:
        r = r.withColumn("_day", F.lit(None).cast("date"))
    edges = r.groupBy(*keys, "_slice", "_day").agg(
        F.max_by("_right", "_right.t").alias("_last"), F.min_by("_right", "_right.t").alias("_first")
    )
    carried = edges.select(
        *keys, (F.col("_slice") + 1).alias("_slice"), F.col("_last").alias("_right"), "_day"
    ).unionByName(
        edges.select(
            *keys, (F.col("_slice") - 1).alias("_slice"), F.col("_first").alias("_right"), "_day"
        )
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    r_all = (
        r.unionByName(carried)
        .withColumn("_salt", salts)
        .withColumn("_t", F.col("_right.t"))
        .withColumn("_is_left", F.lit(False))
    )
    body = [c for c in left.columns if c not in keys]
    l_all = left.select(
        *keys,
        slice_of(left_ts).alias("_slice"),
        (F.to_date(left_ts) if same_day else F.lit(None).cast("date")).alias("_day"),
        F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int").alias("_salt"),
        micros(left_ts).alias("_t"),
        F.lit(True).alias("_is_left"),
        F.struct(*body).alias("_left"),
    )
    merged = l_all.unionByName(r_all, allowMissingColumns=True)
    part = [*keys, "_slice", "_day", "_salt"]
    # at one instant the right row sorts before the left rows
    back = Window.partitionBy(*part).orderBy("_t", "_is_left").rowsBetween(
        Window.unboundedPreceding, 0
    )
    fwd = Window.partitionBy(*part).orderBy(F.col("_t").desc(), F.col("_is_left")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    before = F.last("_right", ignorenulls=True).over(back)
    after = F.last("_right", ignorenulls=True).over(fwd)
    near = (
        merged.withColumns({"_before": before, "_after": after})
        .where("_is_left")
        .withColumn(
            "_pick",
            F.when(
                F.col("_after").isNull()
                | (F.col("_t") - F.col("_before.t") <= F.col("_after.t") - F.col("_t")),
                F.coalesce("_before", "_after"),
            ).otherwise(F.col("_after")),
        )
        .where(F.abs(F.col("_t") - F.col("_pick.t")) <= tol)
    )
    return near.select(
        *keys,
        *[F.col(f"_left.{c}").alias(c) for c in body],
        F.col(f"_pick.{right_ts}").alias(right_ts),
        *[F.col(f"_pick.{v}").alias(v) for v in values],
    )


def common_dates(vd: DataFrame, etag: DataFrame) -> DataFrame:
    """Dates both feeds have."""
    return vd.select("date").intersect(etag.select("date")).orderBy("date")


def coverage(aligned: DataFrame, fused: DataFrame) -> DataFrame:
    """Per date: rows on either side, and whether both have it."""
    a = aligned.groupBy("date").agg(F.count(F.lit(1)).alias("aligned_rows"))
    f = fused.groupBy("date").agg(F.count(F.lit(1)).alias("fused_rows"))
    return a.join(f, "date", "full").select(
        "date",
        F.coalesce("aligned_rows", F.lit(0)).alias("aligned_rows"),
        F.coalesce("fused_rows", F.lit(0)).alias("fused_rows"),
        (F.col("aligned_rows").isNotNull() & F.col("fused_rows").isNotNull())
        .cast("int")
        .alias("in_both"),
    )


def pearson(x: Column, y: Column, n: Column) -> Column:
    """Correlation that is null, not an error, when a side is constant."""
    return F.when(
        n > 1, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    )


def alignment_summary(
    aligned: DataFrame, by: list[str] | None = None, tolerance_min: float = C.SYNC_TOLERANCE_MIN
) -> DataFrame:
    """Rows, regions, pairs, speed correlation, share in tolerance, complete rows, score."""
    n = F.count(F.lit(1))
    keys = by or []
    complete = F.lit(True)
    for c in [c for c in aligned.columns if c not in keys]:
        complete = complete & F.col(c).isNotNull()
    agg = aligned.groupBy(*keys).agg(
        n.alias("total_records"),
        F.countDistinct("region").alias("regions"),
        F.countDistinct("etag_pair").alias("etag_pairs"),
        pearson(F.col("vd_speed"), F.col("etag_speed"), n).alias("speed_correlation"),
        (F.avg((F.col("time_diff_min") <= tolerance_min).cast("int")) * 100).alias(
            "sync_quality_percent"
        ),
        (F.avg(complete.cast("int")) * 100).alias("data_completeness"),
    )
    return agg.withColumn(
        "quality_score",
        F.col("sync_quality_percent") * 0.4
        + F.abs(F.coalesce("speed_correlation", F.lit(0.0))) * 30
        + F.col("data_completeness") * 0.3,
    )
