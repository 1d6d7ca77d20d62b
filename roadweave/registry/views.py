"""The two feeds, read from the provided tables.

``readings`` and ``tolls`` split ``events`` by type into a detector feed and a
gantry feed; ``lanes`` reads ``lineitem`` as a longer detector history. Each view
covers every row of its types. The SQL texts state the same mapping for checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.times import time_category
from roadweave.sources.documents import describe_flows

READING_TYPES = ("view", "click", "signup")
TOLL_TYPES = ("error", "purchase")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vd_id(n: Column) -> Column:
    place = F.when(n % 4 == 0, "圓山").when(n % 4 == 1, "台北").when(n % 4 == 2, "三重").otherwise("LOOP")
    side = F.when(n % 2 == 0, "N").otherwise("S")
    return F.concat(F.lit("VD-N"), 1 + n % 3, F.lit("-"), side, F.lit("-"), n % 60, F.lit("-M-"), place)


def _volumes(total: Column) -> dict[str, Column]:
    return {
        "volume_total": total.cast("int"),
        "volume_small": F.floor(total * 4 / 5.0).cast("int"),
        "volume_large": F.floor(total * 3 / 20.0).cast("int"),
        "volume_truck": F.floor(total / 20.0).cast("int"),
    }


def readings_of(events: DataFrame) -> DataFrame:
    speed = F.col("value")
    return (
        events.where(F.col("event_type").isin(*READING_TYPES))
        .withColumn("update_time", F.col("ts").cast("timestamp"))
        .select(
            F.to_date("update_time").alias("date"),
            "update_time",
            _vd_id(F.col("user_id")).alias("vd_id"),
            (F.col("event_id") % 4).cast("int").alias("lane_id"),
            F.lit(1).alias("lane_type"),
            speed.alias("speed"),
            F.get_json_object("props", "$.k").cast("int").alias("occupancy"),
            *[c.alias(n) for n, c in _volumes(F.col("event_id") % 120).items()],
            speed.alias("speed_small"),
            (speed * 0.9).alias("speed_large"),
            (speed * 0.8).alias("speed_truck"),
            time_category(F.col("update_time")).alias("time_category"),
        )
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return readings_of(table(spark, sf, "events"))


def lanes(spark: SparkSession, sf: str) -> DataFrame:
    speed = F.col("l_quantity") * 3.5
    when = F.timestamp_add("MINUTE", (F.col("l_orderkey") % 1440).cast("int"), F.col("l_shipdate").cast("timestamp"))
    return (
        table(spark, sf, "lineitem")
        .withColumn("update_time", when)
        .select(
            F.to_date("update_time").alias("date"),
            "update_time",
            _vd_id(F.col("l_suppkey")).alias("vd_id"),
            F.col("l_linenumber").cast("int").alias("lane_id"),
            F.lit(1).alias("lane_type"),
            speed.alias("speed"),
            (F.col("l_partkey") % 115).cast("int").alias("occupancy"),
            *[c.alias(n) for n, c in _volumes(F.col("l_orderkey") % 120).items()],
            speed.alias("speed_small"),
            (speed * 0.9).alias("speed_large"),
            (speed * 0.8).alias("speed_truck"),
            time_category(F.col("update_time")).alias("time_category"),
        )
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """A dense detector history: eight detectors of up to seven lanes, a snapshot each minute.

    Every eight orders of ``lineitem`` are a minute, an order is a detector, its line numbers
    are lanes. Speeds go up and down every hour, by the quantity more or less.
    """
    k, minute = F.col("l_orderkey"), F.floor(F.col("l_orderkey") / 8)
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_quantity").alias("q"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    )
    speed = 20 + F.abs(minute % 60 - 30) * 2 + F.floor(F.col("q") / 5)
    return (
        lines.withColumn("update_time", F.timestamp_seconds(F.lit(1_704_067_200) + 60 * minute))
        .withColumn("speed", speed.cast("int"))
        .select(
            F.to_date("update_time").alias("date"),
            "update_time",
            _vd_id(20 + k % 8).alias("vd_id"),
            F.col("l_linenumber").cast("int").alias("lane_id"),
            F.lit(1).alias("lane_type"),
            "speed",
            (F.col("p") % 40).cast("int").alias("occupancy"),
            *[c.alias(n) for n, c in _volumes((F.col("p") * 7 + F.col("s")) % 120).items()],
            F.col("speed").alias("speed_small"),
            (F.col("speed") - 3).alias("speed_large"),
            (F.col("speed") - 6).alias("speed_truck"),
            time_category(F.col("update_time")).alias("time_category"),
        )
    )


def raw_tolls_of(events: DataFrame) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    pair = (
        F.when(u % 5 == 0, "01F0017N-01F0005N")
        .when(u % 5 == 1, "01F0005S-01F0017S")
        .when(u % 5 == 2, "01F0029N-01F0017N")
        .when(u % 5 == 3, "01F0017S-01F0029S")
        .otherwise("01F9999N-01F8888N")
    )
    code = (
        F.when(e % 6 == 0, "31")
        .when(e % 6 == 1, "32")
        .when(e % 6 == 2, "41")
        .when(e % 6 == 3, "42")
        .when(e % 6 == 4, "5")
        .otherwise("99")
    )
    minute = F.col("ts").cast("timestamp")
    return events.where(F.col("event_type").isin(*TOLL_TYPES)).select(
        F.timestamp_seconds(F.floor(F.unix_seconds(minute) / F.lit(60)) * 60).alias("update_time"),
        pair.alias("etag_pair_id"),
        code.alias("vehicle_type_code"),
        (F.get_json_object("props", "$.k").cast("int") * 3).alias("travel_time_seconds"),
        (e % 30).cast("int").alias("vehicle_count"),
        F.col("value").alias("space_mean_speed_kmh"),
        (F.col("value") / 10).alias("standard_deviation"),
        e.alias("flow_pos"),
    )


def tolls_of(events: DataFrame) -> DataFrame:
    return describe_flows(raw_tolls_of(events))


def tolls(spark: SparkSession, sf: str) -> DataFrame:
    return tolls_of(table(spark, sf, "events"))


# --- the same mapping as SQL --------------------------------------------------


def _vd_id_sql(n: str) -> str:
    return (
        f"'VD-N' || (1 + {n} % 3) || '-' || case when {n} % 2 = 0 then 'N' else 'S' end"
        f" || '-' || ({n} % 60) || '-M-' || case {n} % 4 when 0 then '圓山' when 1 then '台北'"
        " when 2 then '三重' else 'LOOP' end"
    )


def _volumes_sql(n: str) -> str:
    return (
        f"cast({n} as int) as volume_total, cast(floor({n} * 4 / 5.0) as int) as volume_small,"
        f" cast(floor({n} * 3 / 20.0) as int) as volume_large,"
        f" cast(floor({n} / 20.0) as int) as volume_truck"
    )


CATEGORY_SQL = """case
  when isodow(update_time) >= 6 and ((hour(update_time) >= 9 and hour(update_time) < 12)
       or (hour(update_time) >= 15 and hour(update_time) < 19)) then '假日尖峰'
  when isodow(update_time) >= 6 then '假日離峰'
  when (hour(update_time) >= 7 and hour(update_time) < 9)
       or (hour(update_time) >= 17 and hour(update_time) < 20) then '平日尖峰'
  else '平日離峰' end"""

READINGS_SQL = f"""readings as (
  select *, {CATEGORY_SQL} as time_category from (
    select cast(ts as date) as date, ts as update_time, {_vd_id_sql('user_id')} as vd_id,
      cast(event_id % 4 as int) as lane_id, 1 as lane_type, value as speed,
      cast(json_extract_string(props, '$.k') as int) as occupancy,
      {_volumes_sql('(event_id % 120)')},
      value as speed_small, value * 0.9::double as speed_large, value * 0.8::double as speed_truck
    from events where event_type in ('view', 'click', 'signup')))"""

LANES_SQL = f"""lanes as (
  select *, {CATEGORY_SQL} as time_category from (
    select cast(l_shipdate as date) as date,
      l_shipdate + to_minutes(cast(l_orderkey % 1440 as int)) as update_time,
      {_vd_id_sql('l_suppkey')} as vd_id, l_linenumber as lane_id, 1 as lane_type,
      l_quantity * 3.5::double as speed, cast(l_partkey % 115 as int) as occupancy,
      {_volumes_sql('(l_orderkey % 120)')},
      l_quantity * 3.5::double as speed_small, l_quantity * 3.5::double * 0.9::double as speed_large,
      l_quantity * 3.5::double * 0.8::double as speed_truck
    from lineitem))"""

SNAPSHOTS_SQL = f"""snapshots as materialized (
  select *, {CATEGORY_SQL} as time_category from (
    select cast(update_time as date) as date, update_time, vd_id, lane_id, 1 as lane_type, speed, p % 40 as occupancy,
      {_volumes_sql('((p * 7 + s) % 120)')},
      speed as speed_small, speed - 3 as speed_large, speed - 6 as speed_truck
    from (select timestamp '2024-01-01' + to_minutes((l_orderkey // 8)::int) as update_time,
        {_vd_id_sql('(20 + l_orderkey % 8)')} as vd_id, l_linenumber::int as lane_id,
        (20 + abs((l_orderkey // 8) % 60 - 30) * 2 + floor(max(l_quantity) / 5))::int as speed,
        min(l_partkey) as p, min(l_suppkey) as s
      from lineitem group by l_orderkey, l_linenumber)))"""

TOLLS_SQL = """pair_info(etag_pair_id, segment_name, distance_km, direction) as (values
    ('01F0017N-01F0005N', '台北→圓山', 1.8::double, 'N'),
    ('01F0005S-01F0017S', '圓山→台北', 1.8::double, 'S'),
    ('01F0029N-01F0017N', '三重→台北', 2.0::double, 'N'),
    ('01F0017S-01F0029S', '台北→三重', 2.0::double, 'S')),
  raw_tolls as (
    select cast(ts as date) as date, date_trunc('minute', ts) as update_time,
      case user_id % 5 when 0 then '01F0017N-01F0005N' when 1 then '01F0005S-01F0017S'
        when 2 then '01F0029N-01F0017N' when 3 then '01F0017S-01F0029S'
        else '01F9999N-01F8888N' end as etag_pair_id,
      case event_id % 6 when 0 then '31' when 1 then '32' when 2 then '41' when 3 then '42'
        when 4 then '5' else '99' end as vehicle_type_code,
      cast(json_extract_string(props, '$.k') as int) * 3 as travel_time_seconds,
      cast(event_id % 30 as int) as vehicle_count, value as space_mean_speed_kmh,
      value / 10 as standard_deviation, event_id as flow_pos
    from events where event_type in ('error', 'purchase')),
  tolls as (
    select t.*, i.segment_name, i.distance_km, i.direction,
      case vehicle_type_code when '31' then '小客車' when '32' then '小貨車' when '41' then '大客車'
        when '42' then '大貨車' when '5' then '聯結車'
        else '未知(' || vehicle_type_code || ')' end as vehicle_type_name,
      case when travel_time_seconds > 0 then round(travel_time_seconds / 60.0::double, 2) else 0 end
        as travel_time_minutes,
      case when travel_time_seconds > 0 and vehicle_count > 0 then 1 else 0 end as data_valid
    from raw_tolls t join pair_info i using (etag_pair_id))"""

PAIR_REGIONS_SQL = """pair_regions(region, etag_pair_id) as (values
    ('圓山', '01F0017N-01F0005N'), ('圓山', '01F0005S-01F0017S'),
    ('台北', '01F0017N-01F0005N'), ('台北', '01F0005S-01F0017S'),
    ('台北', '01F0029N-01F0017N'), ('台北', '01F0017S-01F0029S'),
    ('三重', '01F0029N-01F0017N'), ('三重', '01F0017S-01F0029S'))"""


def bins_sql(source: str, name: str = "bins") -> str:
    return f"""{name} as (
  select region, time_bucket(interval 5 minutes, update_time) as bin, avg(speed) as vd_speed,
    sum(volume_total)::bigint as vd_volume, avg(occupancy) as vd_occupancy
  from {source} join (values ('圓山'), ('台北'), ('三重')) r(region) on contains(vd_id, region)
  group by all)"""


# nearest bin by ranking every bin of the same day
ALIGNED_SQL = f"""{READINGS_SQL}, {TOLLS_SQL}, {PAIR_REGIONS_SQL}, {bins_sql('readings')},
  ranked as (
    select t.date, t.update_time as datetime, p.region, t.etag_pair_id as etag_pair,
      b.vd_speed, b.vd_volume, b.vd_occupancy, t.space_mean_speed_kmh as etag_speed,
      t.vehicle_count as etag_volume, t.vehicle_type_code, t.flow_pos,
      abs(epoch(t.update_time) - epoch(b.bin)) / 60.0 as time_diff_min,
      row_number() over (partition by p.region, t.flow_pos
        order by abs(epoch(t.update_time) - epoch(b.bin)), b.bin) as rn
    from tolls t join pair_regions p using (etag_pair_id)
    join bins b on b.region = p.region and cast(b.bin as date) = t.date),
  aligned as (
    select * exclude (rn) replace (coalesce(vd_speed, 0) as vd_speed,
      coalesce(vd_volume, 0) as vd_volume, coalesce(vd_occupancy, 0) as vd_occupancy)
    from ranked where rn = 1 and time_diff_min <= 2)"""
