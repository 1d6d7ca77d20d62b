"""Queries over rules, cleaning, joins and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave import constants as C
from roadweave.functions import rules
from roadweave.functions.times import is_peak_label, time_category
from roadweave.operators import align as al
from roadweave.operators import clean as cl
from roadweave.operators import features as ft
from roadweave.operators import profile as pr
from roadweave.operators import split, summary
from roadweave.registry import views as V
from roadweave.registry.base import big, day, num, query, ts
from roadweave.session import materialize, scratch_path
from roadweave.sources import documents, tables

# --- alignment ----------------------------------------------------------------

_ALIGNED_OUT = f"""select {day()}, {ts('datetime')}, region, etag_pair, {num('vd_speed')},
  {big('vd_volume')}, {num('vd_occupancy')}, {num('etag_speed')}, {big('etag_volume')},
  {num('time_diff_min')}, vehicle_type_code, {big('flow_pos')}"""


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return al.align(V.readings(spark, sf), V.tolls(spark, sf))


@query("align_nearest_bin", f"with {V.ALIGNED_SQL} {_ALIGNED_OUT} from aligned")
def _align(spark, sf):
    return aligned(spark, sf)


@query(
    "align_wide_tolerance",
    f"with {V.ALIGNED_SQL} {_ALIGNED_OUT} from (select * exclude (rn) from ranked"
    " where rn = 1 and time_diff_min <= 10)",
)
def _align_wide(spark, sf):
    """Tolerance of two bins: the general nearest join."""
    return al.align(V.readings(spark, sf), V.tolls(spark, sf), tolerance_min=10.0)


@query(
    "align_split_direction",
    f"""with {V.READINGS_SQL}, {V.TOLLS_SQL}, {V.PAIR_REGIONS_SQL},
  bins as (
    select region, split_part(vd_id, '-', 3) as direction,
      time_bucket(interval 5 minutes, update_time) as bin, avg(speed) as vd_speed,
      sum(volume_total)::bigint as vd_volume, avg(occupancy) as vd_occupancy
    from readings join (values ('圓山'), ('台北'), ('三重')) r(region) on contains(vd_id, region)
    group by all)
  select {day('t.date', 'date')}, {ts('t.update_time', 'datetime')}, p.region,
    t.etag_pair_id as etag_pair, {num('vd_speed')}, {big('vd_volume')}, {num('vd_occupancy')},
    {num('t.space_mean_speed_kmh', 'etag_speed')}, {big('t.vehicle_count', 'etag_volume')},
    {num('abs(epoch(t.update_time) - epoch(b.bin)) / 60.0', 'time_diff_min')},
    t.vehicle_type_code, {big('t.flow_pos', 'flow_pos')}, b.direction
  from tolls t join pair_regions p using (etag_pair_id)
  join bins b on b.region = p.region and b.direction = t.direction
    and cast(b.bin as date) = t.date and abs(epoch(t.update_time) - epoch(b.bin)) <= 120""",
)
def _align_direction(spark, sf):
    return al.align(V.readings(spark, sf), V.tolls(spark, sf), split_direction=True)


@query(
    "bin5_region",
    f"""with {V.LANES_SQL}, {V.bins_sql('lanes')} select region, {ts('bin')}, {num('vd_speed')},
    {big('vd_volume')}, {num('vd_occupancy')} from bins""",
)
def _bins(spark, sf):
    return al.region_bins(V.lanes(spark, sf))


@query(
    "region_assignment",
    f"""with {V.LANES_SQL} select region, {big('count(*)', 'n')},
    {big('count(distinct vd_id)', 'stations')}
    from lanes join (values ('圓山'), ('台北'), ('三重')) r(region) on contains(vd_id, region)
    group by region""",
)
def _regions(spark, sf):
    return (
        al.with_region(V.lanes(spark, sf))
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vd_id").alias("stations"))
    )


_PEARSON = (
    "case when count(*) > 1 and stddev_pop(vd_speed) * stddev_pop(etag_speed) <> 0 then"
    " covar_pop(vd_speed, etag_speed) / (stddev_pop(vd_speed) * stddev_pop(etag_speed)) end"
)


def _summary_sql(by: str) -> str:
    group = "group by date" if by else ""
    head = f"{day()}," if by else ""
    return f"""with {V.ALIGNED_SQL}, s as (
    select {'date,' if by else ''} count(*) as n, count(distinct region) as regions,
      count(distinct etag_pair) as etag_pairs, {_PEARSON} as r,
      avg(case when time_diff_min <= 2 then 1 else 0 end) * 100 as sync
    from aligned {group})
  select {head} {big('n', 'total_records')}, {big('regions')}, {big('etag_pairs')},
    {num('r', 'speed_correlation')}, {num('sync', 'sync_quality_percent')},
    100.0::double as data_completeness,
    {num('sync * 0.4 + abs(coalesce(r, 0)) * 30 + 30', 'quality_score')} from s"""


@query("align_summary", _summary_sql("date"))
def _align_summary(spark, sf):
    return al.alignment_summary(aligned(spark, sf), ["date"])


@query("align_validation", _summary_sql(""))
def _align_validation(spark, sf):
    return al.alignment_summary(aligned(spark, sf))


@query(
    "common_dates",
    f"""with {V.READINGS_SQL}, {V.TOLLS_SQL}
    select {day()} from (select date from readings intersect select date from tolls)""",
)
def _common(spark, sf):
    return al.common_dates(V.readings(spark, sf), V.tolls(spark, sf))


@query(
    "coverage",
    f"""with {V.ALIGNED_SQL}, a as (select date, count(*) as n from aligned group by date),
    f as (select * from a where date <> (select max(date) from a))
    select {day('a.date', 'date')}, {big('a.n', 'aligned_rows')}, {big('coalesce(f.n, 0)', 'fused_rows')},
      {big('case when f.n is not null then 1 else 0 end', 'in_both')} from a left join f on a.date = f.date""",
)
def _coverage(spark, sf):
    """The stored alignment against the stored fused table, whose newest day is yet to come."""
    stored, fused = scratch_path(spark, "aligned-days"), scratch_path(spark, "fused-days")
    tables.write_days(aligned(spark, sf), stored)
    days = tables.load_days(spark, stored)
    newest = days.agg(F.max("date")).first()[0]
    tables.write_days(ft.fused_features(days.where(F.col("date") != F.lit(newest))), fused)
    return al.coverage(days, tables.load_days(spark, fused))


# --- row rules ------------------------------------------------------------------

_KM = "list_filter(string_split(vd_id, '-'), lambda p: try_cast(p as int) between 20 and 30)"


@query(
    "route_filter",
    f"""with {V.LANES_SQL} select vd_id, {big('count(*)', 'n')} from lanes
    where contains(vd_id, '圓山') or contains(vd_id, '台北') or contains(vd_id, '三重')
      or contains(vd_id, 'N1-N-2') or contains(vd_id, 'N1-S-2')
      or (contains(vd_id, 'N1') and len({_KM}) > 0) group by vd_id""",
)
def _route(spark, sf):
    hit = V.lanes(spark, sf).where(rules.is_target_route(F.col("vd_id")))
    return hit.groupBy("vd_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "route_filter_strict",
    f"""with {V.LANES_SQL} select vd_id, {big('count(*)', 'n')} from lanes
    where contains(vd_id, '圓山') or contains(vd_id, '台北') or contains(vd_id, '三重')
      or (list_contains(string_split(vd_id, '-'), 'N1') and len({_KM}) > 0) group by vd_id""",
)
def _route_strict(spark, sf):
    hit = V.lanes(spark, sf).where(rules.is_target_route(F.col("vd_id"), strict=True))
    return hit.groupBy("vd_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "peak_class",
    f"""with {V.LANES_SQL} select {day()}, time_category, {big('count(*)', 'n')} from lanes
    group by date, time_category""",
)
def _peak_class(spark, sf):
    df = V.lanes(spark, sf).drop("time_category")
    df = df.withColumn("time_category", time_category(F.col("update_time")))
    return df.groupBy("date", "time_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "peak_split",
    f"""with {V.READINGS_SQL} select {ts('update_time')}, vd_id, {big('lane_id')}, {num('speed')}
    from readings where contains(time_category, '尖峰')""",
)
def _peak_split(spark, sf):
    return summary.peak_split(V.readings(spark, sf)).select(
        "update_time", "vd_id", "lane_id", "speed"
    )


@query(
    "vehicle_pivot",
    f"""with {V.LANES_SQL} select vd_id, {big('sum(volume_small + volume_large)', 'volume_total')},
    {big('sum(volume_small)', 'volume_small')}, {big('sum(volume_large)', 'volume_large')},
    0::bigint as volume_truck, {big('sum(occupancy)', 'speed_small')},
    {big('sum(lane_id)', 'speed_large')}, 0::bigint as speed_truck from lanes group by vd_id""",
)
def _pivot(spark, sf):
    """Vehicle lists with a repeated class (the last counts) and an absent one (0)."""

    def entry(code, volume, speed):
        return F.struct(
            F.lit(code).alias("VehicleType"),
            F.col(volume).cast("string").alias("Volume"),
            F.col(speed).cast("string").alias("Speed"),
        )

    listed = V.lanes(spark, sf).select(
        "vd_id",
        F.array(
            entry("S", "volume_total", "lane_id"),
            entry("L", "volume_large", "lane_id"),
            entry("X", "volume_truck", "occupancy"),
            entry("S", "volume_small", "occupancy"),
        ).alias("vehicles"),
    )
    wide = listed.select("vd_id", *[
        c.alias(n) for n, c in documents.vehicle_columns(F.col("vehicles")).items()
    ])
    names = [c for c in wide.columns if c != "vd_id"]
    return wide.groupBy("vd_id").agg(*[F.sum(c).alias(c) for c in names])


@query(
    "traffic_status",
    f"""with {V.LANES_SQL} select case when speed >= 80 then '暢通🟢' when speed >= 50 then '緩慢🟡'
      else '擁堵🔴' end as status, case when speed < 30 then '嚴重擁堵' when speed < 50 then '擁堵'
      when speed < 70 then '順暢' else '非常順暢' end as state, {big('count(*)', 'n')}
    from lanes group by all""",
)
def _status(spark, sf):
    return (
        V.lanes(spark, sf)
        .groupBy(
            rules.traffic_status(F.col("speed")).alias("status"),
            rules.scenario_state(F.col("speed")).alias("state"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- cleaning ---------------------------------------------------------------------

_COLS = list(C.VALID_RANGES)
_BAD = {c: f"({c} < {lo} or {c} > {hi})" for c, (lo, hi) in C.VALID_RANGES.items()}
_MARK = {c: f"({c}::double in (-99, -1, 999, 9999))" for c in _COLS}


@query(
    "violations",
    f"with {V.LANES_SQL} "
    + " union all ".join(
        f"select '{c}' as \"column\", {big(f'count(*) filter ({_MARK[c]})', 'markers')},"
        f" {big(f'count(*) filter ({_BAD[c]})', 'out_of_range')},"
        f" {big(f'count(*) - count({c})', 'missing')},"
        f" {big(f'count(*) filter ({_MARK[c]}) + count(*) filter ({_BAD[c]}) + count(*) - count({c})', 'rule_total')},"
        f" {big(f'count(*) filter ({_BAD[c]}) + count(*) - count({c})', 'bad_cells')} from lanes"
        for c in _COLS
    ),
)
def _violations(spark, sf):
    return cl.violations(V.lanes(spark, sf))


@query(
    "clean_mark_null",
    f"with {V.LANES_SQL}, c as (select date, time_category, "
    + ", ".join(f"case when {_BAD[c]} then null else {c} end as {c}" for c in _COLS)
    + f" from lanes) select {day()}, time_category, {big('count(*)', 'n')}, "
    + ", ".join(f"{big(f'count({c})', f'{c}_n')}, {num(f'sum({c}::double)', f'{c}_sum')}" for c in _COLS)
    + " from c group by date, time_category",
)
def _mark(spark, sf):
    cleaned = cl.mark_null(V.lanes(spark, sf))
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in _COLS:
        aggs += [F.count(c).alias(f"{c}_n"), F.sum(F.col(c).cast("double")).alias(f"{c}_sum")]
    return cleaned.groupBy("date", "time_category").agg(*aggs)


@query(
    "clean_mark_null_rows",
    f"with {V.READINGS_SQL} select {ts('update_time')}, vd_id, {big('lane_id')}, "
    + ", ".join(num(f"case when {_BAD[c]} then null else {c} end", c) for c in _COLS)
    + " from readings",
)
def _mark_rows(spark, sf):
    cells = [F.col(c).cast("double").alias(c) for c in _COLS]
    return cl.mark_null(V.readings(spark, sf)).select("update_time", "vd_id", "lane_id", *cells)


_ALL_OK = " and ".join(f"not {_BAD[c]}" for c in _COLS)


@query(
    "clean_drop_rows",
    f"""with {V.READINGS_SQL} select {ts('update_time')}, vd_id, {big('lane_id')}, {num('speed')},
    {big('volume_total')} from readings where {_ALL_OK}""",
)
def _drop(spark, sf):
    return cl.drop_bad_rows(V.readings(spark, sf)).select(
        "update_time", "vd_id", "lane_id", "speed", "volume_total"
    )


_HITS = " + ".join(
    f"(case when {_MARK[c]} then 1 else 0 end) + (case when {_BAD[c]} then 1 else 0 end)" for c in _COLS
)


@query(
    "clean_report",
    f"""with {V.LANES_SQL} select {day()}, time_category, {big('count(*)', 'original_records')},
    {big(f'count(*) filter ({_ALL_OK})', 'cleaned_records')}, {big(f'sum({_HITS})', 'invalid_values')},
    {big(f'count(*) - count(*) filter ({_ALL_OK})', 'removed_records')},
    {num(f'count(*) filter ({_ALL_OK}) * 100.0 / count(*)', 'kept_percent')}
    from lanes group by date, time_category""",
)
def _report(spark, sf):
    return cl.clean_report(V.lanes(spark, sf), ["date", "time_category"], "remove_rows")


@query(
    "clean_batch_report",
    f"""with {V.LANES_SQL}, g as (select date, time_category, count(*) as o,
      count(*) filter ({_ALL_OK}) as c, sum({_HITS}) as v from lanes group by all),
    d as (select date, sum(o) as o, sum(c) as c, sum(v) as v, count(*) as g,
      count(*) filter (c > 0) as ok from g group by date)
    select {big('count(*)', 'total_dates')}, {big('count(*) filter (ok > 0)', 'successful_dates')},
      {big('sum(g)', 'total_groups')}, {big('sum(ok)', 'successful_groups')},
      {big('sum(o)', 'original_records')}, {big('sum(c)', 'cleaned_records')},
      {big('sum(o) - sum(c)', 'removed_records')}, {big('sum(v)', 'invalid_values')},
      {num('count(*) filter (ok > 0) * 100.0 / count(*)', 'success_rate')} from d""",
)
def _batch_report(spark, sf):
    report = cl.clean_report(V.lanes(spark, sf), ["date", "time_category"], "remove_rows")
    return cl.clean_batch_report(report)


# --- gantry feed ----------------------------------------------------------------


@query(
    "etag_flows",
    f"""with {V.TOLLS_SQL} select {ts('update_time')}, etag_pair_id, vehicle_type_code,
    vehicle_type_name, {big('travel_time_seconds')}, {num('travel_time_minutes')},
    {big('vehicle_count')}, segment_name, direction, {num('distance_km')}, {big('data_valid')},
    {big('flow_pos')} from tolls""",
)
def _flows(spark, sf):
    return V.tolls(spark, sf).drop("date", "space_mean_speed_kmh", "standard_deviation")


@query(
    "valid_flows",
    f"""with {V.TOLLS_SQL} select {ts('update_time')}, etag_pair_id, {big('flow_pos')}
    from tolls where data_valid = 1""",
)
def _valid(spark, sf):
    return summary.valid_flows(V.tolls(spark, sf)).select("update_time", "etag_pair_id", "flow_pos")


@query(
    "vehicle_stats",
    f"""with {V.TOLLS_SQL} select etag_pair_id, vehicle_type_name,
    {big('sum(vehicle_count)', 'vehicle_count')},
    {num('avg(travel_time_seconds)', 'travel_time_seconds')},
    {num('avg(space_mean_speed_kmh)', 'space_mean_speed_kmh')},
    {big('sum(data_valid)', 'data_valid')} from tolls group by etag_pair_id, vehicle_type_name""",
)
def _vehicle_stats(spark, sf):
    return summary.vehicle_stats(V.tolls(spark, sf))


@query(
    "pair_summary",
    f"""with {V.TOLLS_SQL} select {day()}, etag_pair_id, {big('count(*)', 'records')},
    {big('sum(vehicle_count)', 'vehicle_count')}, {big('sum(data_valid)', 'data_valid')},
    {ts('min(update_time)', 'start_time')}, {ts('max(update_time)', 'end_time')},
    {num('(epoch(max(update_time)) - epoch(min(update_time))) / 3600.0', 'span_hours')}
    from tolls group by date, etag_pair_id""",
)
def _pairs(spark, sf):
    return summary.pair_stats(V.tolls(spark, sf), ["date"])


@query(
    "gantry_day_summary",
    f"""with {V.TOLLS_SQL} select {day()}, {big('count(*)', 'total_records')},
    {big('sum(data_valid)', 'valid_records')},
    {num('sum(data_valid) * 100.0 / count(*)', 'validity_rate')},
    {big('count(distinct etag_pair_id)', 'unique_pairs')}, {ts('min(update_time)', 'start_time')},
    {ts('max(update_time)', 'end_time')},
    {num('(epoch(max(update_time)) - epoch(min(update_time))) / 3600.0', 'span_hours')},
    {big("count(*) filter (vehicle_type_name = '小客車')", 'cars')},
    {big("count(*) filter (vehicle_type_name = '未知(99)')", 'unknown_types')},
    {big("coalesce(sum(vehicle_count) filter (etag_pair_id = '01F0017N-01F0005N'), 0)", 'north_vehicles')},
    {big("coalesce(sum(data_valid) filter (etag_pair_id = '01F0017N-01F0005N'), 0)", 'north_valid')}
    from tolls group by date""",
)
def _gantry_days(spark, sf):
    df = summary.gantry_day_summary(V.tolls(spark, sf))

    def pick(column: str, key: str):
        return F.coalesce(F.try_element_at(F.col(column), F.lit(key)), F.lit(0))

    return df.withColumns(
        {
            "cars": pick("vehicle_type_distribution", "小客車"),
            "unknown_types": pick("vehicle_type_distribution", "未知(99)"),
            "north_vehicles": pick("pair_vehicle_count", "01F0017N-01F0005N"),
            "north_valid": pick("pair_data_valid", "01F0017N-01F0005N"),
        }
    ).drop("vehicle_type_distribution", "pair_vehicle_count", "pair_data_valid")


@query(
    "gantry_store_summary",
    f"""with {V.TOLLS_SQL} select {big('count(distinct date)', 'processed_dates')},
    {big('count(*)', 'total_records')}, {big('sum(data_valid)', 'valid_records')} from tolls""",
)
def _gantry_store(spark, sf):
    return summary.gantry_store_summary(summary.gantry_day_summary(V.tolls(spark, sf)))


# --- day tables -------------------------------------------------------------------

_IS_PEAK = "contains(time_category, '尖峰')"


@query(
    "day_summary",
    f"""with {V.LANES_SQL} select {day()}, {big('count(*)', 'total_records')},
    {big(f'count(*) filter ({_IS_PEAK})', 'peak_records')},
    {big(f'count(*) filter (not {_IS_PEAK})', 'offpeak_records')}, {num('avg(speed)', 'avg_speed')},
    {num('avg(volume_total)', 'avg_volume')}, {big('count(distinct vd_id)', 'unique_vd_count')}
    from lanes group by date""",
)
def _days(spark, sf):
    return summary.day_summary(summary.station_day(V.lanes(spark, sf)))


@query(
    "store_summary",
    f"""with {V.LANES_SQL} select {big('count(distinct date)', 'available_dates')},
    {big('count(*)', 'total_records')}, {day('min(date)', 'start_date')},
    {day('max(date)', 'end_date')} from lanes""",
)
def _store(spark, sf):
    return summary.store_summary(summary.day_summary(summary.station_day(V.lanes(spark, sf))))


@query(
    "available_dates",
    f"with {V.LANES_SQL} select distinct {day()} from lanes",
)
def _dates(spark, sf):
    return tables.available_dates(V.lanes(spark, sf))


@query(
    "newest_day",
    f"""with {V.READINGS_SQL} select {ts('update_time')}, vd_id, {num('speed')} from readings
    where date = (select max(date) from readings)""",
)
def _newest(spark, sf):
    return tables.newest_day(V.readings(spark, sf)).select("update_time", "vd_id", "speed")


@query(
    "load_one_day",
    f"""with {V.READINGS_SQL} select {ts('update_time')}, vd_id, time_category from readings
    where date = date '2024-01-15'""",
)
def _one_day(spark, sf):
    """All days written as a partitioned table, one read back through pruning."""
    path = scratch_path(spark, "lane-days")
    tables.write_lane_days(V.readings(spark, sf), path)
    return tables.load_days(spark, path, "2024-01-15").select("update_time", "vd_id", "time_category")


@query(
    "append_without_repeats",
    f"""with {V.READINGS_SQL} select {day()}, time_category, {big('count(*)', 'n')} from readings
    group by date, time_category""",
)
def _append(spark, sf):
    """The off-peak rows, then everything again: each row is stored once."""
    path = scratch_path(spark, "append")
    rows = V.readings(spark, sf)
    tables.write_lane_days(tables.named_dataset(rows, "offpeak"), path)
    tables.write_lane_days(rows, path)
    return (
        tables.load_days(spark, path).groupBy("date", "time_category").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "source_priority",
    f"""with {V.READINGS_SQL}, done as (select * from readings where isodow(date) <= 5 and {_ALL_OK}),
    merged as (select * from done union all
      select * from readings where date not in (select date from done))
    select {day()}, {big('count(*)', 'n')}, {num('sum(speed)', 'speed_sum')} from merged group by date""",
)
def _priority(spark, sf):
    """Cleaned working days, raw rows for the days not cleaned."""
    raw = V.readings(spark, sf)
    cleaned = cl.drop_bad_rows(raw.where(F.weekday("date") < 5))
    return (
        tables.prefer(cleaned, raw)
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("speed_sum"))
    )


@query(
    "preview",
    f"""with {V.LANES_SQL}, d as (select distinct date from lanes order by date limit 3),
    r as (select *, row_number() over (partition by date, {_IS_PEAK}
        order by update_time, vd_id, lane_id, speed, occupancy, volume_total) as rn
      from lanes where date in (select date from d))
    select {ts('update_time')}, vd_id, {num('speed')} from r where rn <= 5""",
)
def _preview(spark, sf):
    df = V.lanes(spark, sf).withColumn("is_peak", is_peak_label(F.col("time_category")))
    order = ["update_time", "vd_id", "lane_id", "speed", "occupancy", "volume_total"]
    return split.preview(df, "date", ["is_peak"], order, days=3, rows=5).select(
        "update_time", "vd_id", "speed"
    )


@query(
    "sample_sizes",
    f"""with {V.LANES_SQL} select {day()}, {big('round(count(*) * 0.25::double)', 'n')} from lanes
    group by date having round(count(*) * 0.25::double) > 0""",
)
def _sample_sizes(spark, sf):
    ident = ["vd_id", "lane_id", "update_time", "occupancy", "speed", "volume_total"]
    picked = split.sample_exact(V.lanes(spark, sf), "date", ident, 0.25)
    return picked.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_rows",
    f"""with {V.READINGS_SQL}, h as (select *, ('0x' || substr(md5(concat_ws('|', vd_id, lane_id::varchar,
      epoch_us(update_time)::varchar, '42')), 1, 15))::ubigint as h from readings),
    r as (select *, row_number() over (partition by date order by h, vd_id, lane_id, update_time) as rn,
      round(count(*) over (partition by date) * 0.25::double) as want from h)
    select {ts('update_time')}, vd_id, {big('lane_id')}, {num('speed')} from r where rn <= want""",
)
def _sample_rows(spark, sf):
    """A quarter of each day's rows, chosen by a seeded hash."""
    picked = split.sample_exact(
        V.readings(spark, sf), "date", ["vd_id", "lane_id", "update_time"], 0.25
    )
    return picked.select("update_time", "vd_id", "lane_id", "speed")


@query(
    "merged_datasets",
    f"""with {V.READINGS_SQL}, {V.LANES_SQL},
    m as (select date, speed, 'recent' as dataset from readings union all
      select date, speed, 'history' as dataset from lanes)
    select dataset, {day('date', 'source_date')}, {big('count(*)', 'n')}, {num('avg(speed)', 'avg_speed')}
    from m group by dataset, date""",
)
def _merged(spark, sf):
    recent = tables.with_dataset(V.readings(spark, sf), "recent")
    history = tables.with_dataset(V.lanes(spark, sf), "history")
    return (
        tables.merge_days(recent, history)
        .groupBy("dataset", "source_date")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("avg_speed"))
    )


@query(
    "json_day_report",
    f"""with {V.LANES_SQL} select json_object('date', strftime(date, '%Y-%m-%d'), 'n', count(*),
      'stations', count(distinct vd_id))::varchar as report from lanes group by date""",
)
def _json(spark, sf):
    days = V.lanes(spark, sf).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vd_id").alias("stations")
    )
    return summary.to_json_report(days)


# --- ingest -----------------------------------------------------------------------


_FILE_NAMES = {
    "view": "VD_live_",
    "click": "traffic_",
    "signup": "靜態_",
    "error": "weather_",
    "purchase": "Detector_",
}


@query(
    "pending_files",
    "select case event_type "
    + " ".join(f"when '{t}' then '{n}'" for t, n in _FILE_NAMES.items())
    + """ end || event_id || '.xml' as file_name from events
    where event_type in ('signup', 'purchase') or (event_type = 'click' and value > 100)""",
)
def _pending(spark, sf):
    """Every event names a file; the ledger holds those of one type and some of another."""
    ev = V.table(spark, sf, "events")
    prefix = F.create_map(*[F.lit(x) for kv in _FILE_NAMES.items() for x in kv])[F.col("event_type")]
    name = F.concat(prefix, F.col("event_id"), F.lit(".xml"))
    files = ev.select(name.alias("file_name")).where(rules.is_vd_file(F.col("file_name")))
    archived = ev.where(
        (F.col("event_type") == "view") | ((F.col("event_type") == "click") & (F.col("value") <= 100))
    )
    ledger = archived.select(
        F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), name).alias("archived_name")
    )
    return documents.pending_files(files, ledger)


@query(
    "normalized_types",
    """select event_type, sum(case when event_id % 3 = 0 then value end)::double as speed,
    count(*) filter (event_id % 3 = 0)::bigint as n, count(*) filter (event_id % 2 = 0)::bigint as timed
    from events group by event_type""".replace(
        "sum(case when event_id % 3 = 0 then value end)::double",
        "round(sum(case when event_id % 3 = 0 then value end), 6)",
    ),
)
def _normalized(spark, sf):
    """Text columns: numbers, junk and NaN; readable and unreadable times."""
    e = F.col("event_id")
    raw = V.table(spark, sf, "events").select(
        "event_type",
        F.when(e % 3 == 0, F.col("value").cast("string"))
        .when(e % 3 == 1, "n/a")
        .otherwise("NaN")
        .alias("speed"),
        F.when(e % 2 == 0, F.col("ts").cast("string")).otherwise("soon").alias("update_time"),
    )
    return cl.normalize_types(raw).groupBy("event_type").agg(
        F.sum("speed").alias("speed"),
        F.count("speed").alias("n"),
        F.count("update_time").alias("timed"),
    )


@query(
    "metric_bands",
    f"""with {V.LANES_SQL} select case when speed < 50 then 'excellent' when speed < 100 then 'good'
      else 'needs work' end as latency, case when occupancy / 100.0 > 0.8 and volume_total > 80
      then 'excellent' when occupancy / 100.0 > 0.7 and volume_total > 70 then 'good'
      else 'needs work' end as accuracy, case when occupancy / 100.0 > 0.9 then 'excellent'
      when occupancy / 100.0 > 0.8 then 'good' else 'needs work' end as tuning,
      {big('count(*)', 'n')} from lanes group by all""",
)
def _bands(spark, sf):
    df = V.lanes(spark, sf)
    return df.groupBy(
        rules.latency_band(F.col("speed")).alias("latency"),
        rules.accuracy_band(F.col("occupancy") / 100.0, F.col("volume_total")).alias("accuracy"),
        rules.tuning_band(F.col("occupancy") / 100.0).alias("tuning"),
    ).agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to as many tasks as a shuffle has, before CPU-bound text work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def vd_xml(df: DataFrame) -> DataFrame:
    """Lane rows as one snapshot document each, in the feed's element names."""

    def text(c):
        return F.col(c).cast("string")

    def vehicle(code, kind):
        return F.struct(
            F.lit(code).alias("VehicleType"),
            text(f"volume_{kind}").alias("Volume"),
            F.floor(f"speed_{kind}").cast("string").alias("Speed"),
        )

    lane = F.struct(
        text("lane_id").alias("LaneID"),
        text("lane_type").alias("LaneType"),
        F.floor("speed").cast("string").alias("Speed"),
        text("occupancy").alias("Occupancy"),
        F.struct(
            F.array(vehicle("S", "small"), vehicle("L", "large"), vehicle("T", "truck")).alias("Vehicle")
        ).alias("Vehicles"),
    )
    live = F.struct(F.col("vd_id").alias("VDID"), F.array(lane).alias("Lane"))
    doc = F.struct(
        F.concat(F.date_format("update_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")).alias("UpdateTime"),
        F.array(live).alias("VDLive"),
    )
    return df.select(
        F.to_xml(doc, {"rowTag": "VDLiveList"}).alias("content"),
        F.lit("vd.xml").alias("file_name"),
        F.col("update_time").alias("modified"),
    )


@query(
    "xml_vd_ingest",
    f"""with {V.READINGS_SQL} select {day()}, {ts('update_time')}, vd_id, {big('lane_id')},
    {big('floor(speed)', 'speed')}, {big('occupancy')},
    {big('volume_small + volume_large + volume_truck', 'volume_total')}, {big('volume_small')},
    {big('floor(speed_large)', 'speed_large')}, {big('floor(speed_truck)', 'speed_truck')}
    from readings where contains(vd_id, '圓山') or contains(vd_id, '台北') or contains(vd_id, '三重')
      or contains(vd_id, 'N1-N-2') or contains(vd_id, 'N1-S-2')
      or (contains(vd_id, 'N1') and len({_KM}) > 0)""",
)
def _xml_vd(spark, sf):
    docs = vd_xml(spread(V.readings(spark, sf)))
    return documents.parse_vd(docs).select(
        "date", "update_time", "vd_id", "lane_id", "speed", "occupancy", "volume_total",
        "volume_small", "speed_large", "speed_truck",
    )


@query(
    "xml_etag_ingest",
    f"""with {V.TOLLS_SQL} select {ts('update_time')}, etag_pair_id, vehicle_type_name,
    {big('travel_time_seconds')}, {big('vehicle_count')}, {num('space_mean_speed_kmh')},
    segment_name, {big('data_valid')} from tolls""",
)
def _xml_etag(spark, sf):
    """Gantry rows as documents in dated folders, parsed back."""
    raw = spread(V.raw_tolls_of(V.table(spark, sf, "events")))

    def text(c):
        return F.col(c).cast("string")

    flow = F.struct(
        F.col("vehicle_type_code").alias("VehicleType"),
        text("travel_time_seconds").alias("TravelTime"),
        text("standard_deviation").alias("StandardDeviation"),
        text("space_mean_speed_kmh").alias("SpaceMeanSpeed"),
        text("vehicle_count").alias("VehicleCount"),
    )
    pair = F.struct(
        F.col("etag_pair_id").alias("ETagPairId"), F.struct(F.array(flow).alias("Flow")).alias("Flows")
    )
    doc = F.struct(
        F.lit("2020-01-01T00:00:00+08:00").alias("UpdateTime"),
        F.struct(F.array(pair).alias("ETagPairLive")).alias("ETagPairLives"),
    )
    name = F.concat(F.lit("ETagPairLive_"), F.date_format("update_time", "HHmm"), F.lit(".xml.gz"))
    docs = raw.select(
        F.to_xml(doc, {"rowTag": "ETagPairLiveList"}).alias("content"),
        name.alias("file_name"),
        F.concat(
            F.lit("/raw/ETag_Data_"), F.date_format("update_time", "yyyyMMdd"), F.lit("/"), name
        ).alias("file_path"),
    )
    return documents.parse_etag(documents.with_folder_date(docs)).select(
        "update_time", "etag_pair_id", "vehicle_type_name", "travel_time_seconds", "vehicle_count",
        "space_mean_speed_kmh", "segment_name", "data_valid",
    )


# --- profile ----------------------------------------------------------------------


def _rollup(spark, sf) -> DataFrame:
    return summary.station_day(cl.mark_null(V.lanes(spark, sf)))


def _ready(spark, sf) -> DataFrame:
    return pr.readiness(pr.facts(_rollup(spark, sf)))


_CLEAN = (
    f"{V.LANES_SQL}, cleaned as (select * replace ("
    + ", ".join(f"case when {_BAD[c]} then null else {c} end as {c}" for c in _COLS)
    + ") from lanes)"
)
_ALL_COLS = (
    "date update_time vd_id lane_id lane_type speed occupancy volume_total volume_small volume_large"
    " volume_truck speed_small speed_large speed_truck time_category"
).split()
_CELLS = " + ".join(f"count({c})" for c in _ALL_COLS)
_DATASETS = (
    f"{_CLEAN}, tagged as (select *, 'all' as dataset from cleaned union all select *,"
    f" case when {_IS_PEAK} then 'peak' else 'offpeak' end as dataset from cleaned)"
)


@query(
    "profile",
    f"""with {_DATASETS} select dataset, {big('count(*)', 'records')},
    {num('round(avg(speed), 2)', 'avg_speed')}, {num('round(avg(volume_total), 2)', 'avg_volume')},
    {big('count(distinct vd_id)', 'unique_vd_stations')},
    {num(f'round(({_CELLS}) * 100.0 / (count(*) * {len(_ALL_COLS)}), 1)', 'completeness')}
    from tagged group by dataset""",
)
def _profile(spark, sf):
    return pr.dataset_profile(_rollup(spark, sf))


_READY = f"""{_CLEAN}, r0 as (select count(*) as n, count(distinct vd_id) as vds,
    count(distinct date) as days,
    (epoch(max(update_time)) - epoch(min(update_time))) / 3600.0 as hours,
    count(speed) * 100.0 / count(*) as c1, count(volume_total) * 100.0 / count(*) as c2,
    count(occupancy) * 100.0 / count(*) as c3,
    count(*) filter ({_IS_PEAK}) as peak_n, count(*) filter (not {_IS_PEAK}) as off_n from cleaned),
  r1 as (select *, (c1 + c2 + c3) / 3 as done from r0),
  ready as (select *, n >= 50000 and days >= 5 and done >= 80 and vds >= 3 as lstm,
    n >= 10000 and done >= 70 and vds >= 2 as xgb, n >= 5000 and done >= 60 as rf from r1),
  scored as (select *, (case when lstm then 40 when xgb then 25 when rf then 15 else 0 end)
      + least(30, done * 0.3) + least(20, days * 2) + least(10, vds * 2) as ready_score,
      2 * n as total from ready),
  quality as (select *, least(100, total / 1000.0) as vol, least(100, days * 20) as tim,
      least(peak_n, off_n) * 100.0 / greatest(peak_n, off_n) as bal from scored),
  overall as (select *, round(vol * 0.3 + tim * 0.3 + bal * 0.2 + ready_score * 0.2, 1) as q from quality)"""


@query(
    "time_coverage",
    f"""with {_READY} select {big('total', 'total_records')}, {big('days', 'unique_dates')},
    {big('days', 'date_span_days')}, {num('round(total / days::double, 0)', 'records_per_day')},
    {num('round(total / 720.0::double, 1)', 'estimated_ai_training_hours')} from overall""",
)
def _time_coverage(spark, sf):
    return pr.time_coverage(pr.facts(_rollup(spark, sf)))


@query(
    "readiness",
    f"""with {_READY} select {big('n', 'total_records')}, {big('vds', 'unique_vd_stations')},
    {big('days', 'time_span_days')}, {num('hours', 'time_span_hours')},
    {num('c1', 'speed_completeness')}, {num('c2', 'volume_total_completeness')},
    {num('c3', 'occupancy_completeness')}, {num('done', 'avg_completeness')},
    {big('lstm', 'lstm_ready')}, {big('xgb', 'xgboost_ready')}, {big('rf', 'rf_ready')},
    {big('lstm or xgb', 'prediction_ready')}, {num('ready_score', 'prediction_score')} from scored""",
)
def _readiness(spark, sf):
    return _ready(spark, sf).select(*pr.READINESS_COLUMNS)


@query(
    "quality_score",
    f"""with {_READY} select {num('round(vol, 1)', 'volume_score')},
    {num('round(tim, 1)', 'time_score')}, {num('round(bal, 1)', 'balance_score')},
    {num('round(ready_score, 1)', 'prediction_score')}, {num('q', 'overall_quality')} from overall""",
)
def _quality(spark, sf):
    return pr.quality_metrics(_ready(spark, sf))


_FIT = f"""{_READY}, fit as (
    select 0 as position, 'lstm_time_series' as model,
      round(least(50, n / 1000.0) + least(30, days * 4) + least(20, done * 0.2), 1) as score,
      lstm as ok, '85-92%' as acc, '時間序列學習|長期依賴捕捉' as pros from overall
    union all select 1, 'xgboost_ensemble', round(least(100, (n / 10000.0) * 40 + done * 0.6), 1),
      xgb, '80-88%', '高預測精度|特徵重要性' from overall
    union all select 2, 'random_forest_baseline', round(least(100, (n / 5000.0) * 35 + done * 0.65), 1),
      rf, '75-82%', '穩定基線|易於理解' from overall),
  best as (select *, row_number() over (order by score desc, position) as place from fit where ok)"""


@query(
    "model_suitability",
    f"with {_FIT} select {big('position')}, model, {num('score')}, {big('ok', 'suitable')},"
    " acc as expected_accuracy from fit",
)
def _suitability(spark, sf):
    return pr.model_suitability(_ready(spark, sf)).drop("pros", "cons")


@query(
    "ranked_models",
    f"""with {_FIT} select {big('place', 'rank')}, model,
    case place when 1 then '🥇 首選' when 2 then '🥈 次選' else '🥉 備選' end as priority, {num('score')},
    '適合交通預測的' || model || '模型' as reason, pros, acc as expected_accuracy,
    case acc when '85-92%' then 88.5 when '80-88%' then 84.0 else 78.5 end::double as expected_accuracy_mid
    from best where place <= 3""",
)
def _ranked(spark, sf):
    best = pr.recommendations(_ready(spark, sf))
    return best.withColumn("pros", F.concat_ws("|", "pros"))


@query(
    "insights",
    f"""with {_READY}, m as (select unnest([
      case when total > 50000 then '🚀 優秀數據規模：' || format('{{:,}}', total) || '筆記錄支援深度學習模型' end,
      case when lstm then '🎯 LSTM模型就緒：數據符合時間序列深度學習要求'
        when xgb then '📊 XGBoost模型就緒：適合高精度梯度提升預測'
        when rf then '🌲 隨機森林模型就緒：適合作為預測基線' end,
      case when days >= 7 then '📅 週期性分析就緒：' || days || '天數據支援週期模式學習' end,
      case when vds >= 5 then '🛣️ 多站點預測：' || vds || '個VD站點支援路段級預測' end]) as insight,
      unnest([1, 2, 3, 4]) as p from scored)
    select {big('row_number() over (order by p)', 'position')}, insight from m where insight is not null""",
)
def _insights(spark, sf):
    return pr.insights(_ready(spark, sf))


@query(
    "actions",
    f"""with {_FIT}, t as (select max(model) as model, max(acc) as acc from best where place = 1),
    m as (select unnest(['🎯 立即開發 ' || t.model || ' 模型', '📈 預期準確率: ' || t.acc,
      case when lstm then '🚀 數據符合LSTM要求 - 可開始深度學習開發' end,
      case when vds >= 5 then '🛣️ 多站點預測能力 - 可實現路段級交通預測' end]) as action,
      unnest([1, 2, 3, 4]) as p from overall, t)
    select {big('row_number() over (order by p)', 'position')}, action from m where action is not null""",
)
def _actions(spark, sf):
    return pr.actions(_ready(spark, sf))


@query(
    "report",
    f"""with {_FIT} select {big('total', 'total_records')}, {num('q', 'overall_quality')},
      {num('done', 'avg_completeness')}, 3::bigint as datasets,
      (select count(*) from best where place <= 3)::bigint as recommended,
      coalesce((select max(model) from best where place = 1), '') as top_model from overall""",
)
def _full_report(spark, sf):
    """The whole analysis as one JSON document, some of it read back."""
    rollup = materialize(_rollup(spark, sf), "station-day")
    doc = summary.to_json_report(pr.report(rollup))

    def field(path):
        return F.get_json_object("report", path)

    names = F.from_json(field("$.recommendations"), "array<struct<model:string>>")
    parts = F.from_json(field("$.data_summary"), "array<struct<dataset:string>>")
    return doc.select(
        field("$.time_coverage.total_records").cast("long").alias("total_records"),
        field("$.quality_assessment.overall_quality").cast("double").alias("overall_quality"),
        field("$.prediction_readiness.avg_completeness").cast("double").alias("avg_completeness"),
        F.size(parts).alias("datasets"),
        F.size(names).alias("recommended"),
        F.coalesce(F.try_element_at(names, F.lit(1))["model"], F.lit("")).alias("top_model"),
    )


@query(
    "peak_compare",
    f"""with {_CLEAN} select case when {_IS_PEAK} then 'peak' else 'offpeak' end as period,
    {num('avg(speed)', 'avg_speed')}, {num('avg(volume_total)', 'avg_volume')},
    {big('count(*)', 'records')} from cleaned group by 1""",
)
def _peak_compare(spark, sf):
    return pr.peak_comparison(_rollup(spark, sf))


@query(
    "vehicle_mix",
    f"with {_CLEAN} "
    + " union all ".join(
        f"select '{c}' as vehicle_class, {num(f'avg({c})', 'mean_volume')},"
        f" {num(f'sum({c}::double)', 'total_volume')} from cleaned"
        for c in ("volume_small", "volume_large", "volume_truck")
    ),
)
def _mix(spark, sf):
    return pr.vehicle_mix(_rollup(spark, sf))


@query(
    "dataset_quality",
    f"""with {_DATASETS} select dataset, {big('count(*)', 'records')},
    {num(f'round(({_CELLS}) * 100.0 / (count(*) * {len(_ALL_COLS)}), 1)', 'completeness')},
    (case when count(*) > 1000 then 90 else 70 end)::double as quality_score
    from tagged group by dataset""",
)
def _dataset_quality(spark, sf):
    return pr.dataset_quality(_rollup(spark, sf))


@query(
    "kpis",
    f"""with {_FIT}, t as (select max(model) as model, max(score) as score from best where place = 1),
    v as (select avg(volume_total) filter ({_IS_PEAK}) as pv,
      avg(volume_total) filter (not {_IS_PEAK}) as ov, avg(speed) filter ({_IS_PEAK}) as sp from cleaned)
    select {big('total', 'total_records')}, {big('lstm', 'ai_ready')},
      coalesce(t.model, '無推薦') as top_model, {num('coalesce(t.score, 0)', 'top_score')},
      {num('pv', 'peak_volume')}, {num('ov', 'offpeak_volume')}, {num('sp', 'avg_speed')},
      {num('q', 'overall_quality')},
      {big('case when lstm and q >= 80 and total >= 50000 then 100 else 75 end', 'system_status')},
      {big('case when lstm then 90 else 60 end', 'prediction_ready')} from overall, t, v""",
)
def _kpis(spark, sf):
    return pr.kpis(_ready(spark, sf))


@query(
    "next_action",
    f"""with {V.READINGS_SQL} select (select count(*) from events where event_type = 'error')::bigint
      as pending_files, count(distinct date)::bigint as stored_dates,
      'raw_processing_needed' as overall_readiness, 'process_raw_files' as next_action from readings""",
)
def _next(spark, sf):
    files = V.table(spark, sf, "events").where(F.col("event_type") == "error").select("event_id")
    return pr.next_action(files, tables.available_dates(V.readings(spark, sf)))


def _user_files(spark, sf) -> DataFrame:
    """One file per user, two of seven with other columns."""
    u = F.col("user_id") % 7
    names = (
        F.when(u == 3, F.array(*[F.lit(x) for x in ("date", "speed", "region", "debug")]))
        .when(u == 5, F.array(F.lit("date"), F.lit("speed")))
        .otherwise(F.array(*[F.lit(x) for x in ("date", "speed", "region")]))
    )
    per_user = V.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    return per_user.select(F.col("user_id").alias("file"), names.alias("columns"), "size")


@query(
    "schema_drift",
    f"""with f as (select user_id as file, count(*) as size,
      case user_id % 7 when 3 then ['date', 'speed', 'region', 'debug'] when 5 then ['date', 'speed']
        else ['date', 'speed', 'region'] end as columns from events group by user_id),
    a as (select avg(size) as m from f)
    select {big('file')}, {big('len(columns)', 'column_count')}, 3::bigint as modal_count,
      case when user7 = 3 then 'debug' else '' end as extra_columns,
      case when user7 = 5 then 'region' else '' end as missing_columns, {big('size')},
      case when size < m * 0.5 then 'too small' when size > m * 2 then 'too large' else 'normal' end
        as size_check
    from (select *, file % 7 as user7 from f), a""",
)
def _drift(spark, sf):
    out = tables.flag_schema_drift(_user_files(spark, sf))
    return out.withColumns(
        {c: F.concat_ws(",", c) for c in ("extra_columns", "missing_columns")}
    )


@query(
    "schema_histogram",
    """select column_count::bigint as column_count, count(*)::bigint as files from (
      select user_id, case user_id % 7 when 3 then 4 when 5 then 2 else 3 end as column_count
      from events group by user_id) group by column_count""",
)
def _histogram(spark, sf):
    return tables.column_histogram(_user_files(spark, sf))


@query(
    "file_completeness",
    f"""with {V.READINGS_SQL}, f as (select distinct date, time_category, lane_id from readings)
    select {day()}, {big('count(*)', 'files')}, 8::bigint as expected,
      {big('case when count(*) >= 8 then 1 else 0 end', 'is_complete')} from f group by date""",
)
def _completeness(spark, sf):
    """One file per date, category and lane."""
    files = V.readings(spark, sf).select("date", "time_category", "lane_id").distinct()
    return tables.file_completeness(files, 8)


@query(
    "table_files",
    f"""with {V.READINGS_SQL} select {day()}, {big('count(*)', 'records')}, 1::bigint as has_files
    from readings group by date""",
)
def _files(spark, sf):
    """Files and exact rows per date of a stored table (sizes depend on the writer)."""
    path = scratch_path(spark, "files")
    tables.write_days(V.readings(spark, sf), path)
    return tables.store_files(spark, path).select(
        "date", "records", (F.col("files") > 0).cast("int").alias("has_files")
    )
