"""Queries over features, selection, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave import constants as C
from roadweave.functions.rules import accuracy_band, tuning_band
from roadweave.operators import features as ft
from roadweave.operators import metrics, select, series, split
from roadweave.registry import views as V
from roadweave.registry.base import big, day, num, query, ts
from roadweave.registry.feeds import aligned, vd_xml
from roadweave.session import materialize, scratch_path
from roadweave.sources import documents, tables
from roadweave.streaming import jobs

KEYS, ORDER = ["vd_id", "lane_id"], ["update_time"]
_W = "over (partition by vd_id, lane_id order by update_time)"


def _frame(n: int) -> str:
    return (
        "over (partition by vd_id, lane_id order by update_time"
        f" rows between {n - 1} preceding and current row)"
    )


# --- series -----------------------------------------------------------------------

_LAYOUTS: dict[tuple, series.SeriesTable] = {}


def _layout(spark: SparkSession, sf: str, keys: list[str]) -> series.SeriesTable:
    """The readings as they are stored for frames, once for each table and session."""
    name = (spark.sparkContext.applicationId, sf, *keys)
    if name not in _LAYOUTS:
        path = scratch_path(spark, "layout")
        table = path.rsplit("/", 1)[-1].replace("-", "_")
        _LAYOUTS[name] = series.SeriesTable.store(V.readings(spark, sf), table, path, keys, ORDER, 12, 3)
    return _LAYOUTS[name]

_PERIODS, _WINDOWS = (1, 2, 3, 6, 12), (3, 6, 12)


@query(
    "lags",
    f"with {V.READINGS_SQL} select vd_id, {big('lane_id')}, {ts('update_time')}, "
    + ", ".join(num(f"lag(speed, {p}) {_W}", f"speed_lag_{p}") for p in _PERIODS)
    + " from readings",
)
def _lags(spark, sf):
    found = series.lags(_layout(spark, sf, KEYS), KEYS, ORDER, ["speed"])
    return found.select(*KEYS, *ORDER, *[f"speed_lag_{p}" for p in _PERIODS])


@query(
    "lags_split_days",
    f"with {V.READINGS_SQL} select vd_id, {ts('update_time')}, {num('lag(speed, 2) over w', 'speed_lag_2')}"
    " from readings window w as (partition by vd_id order by update_time)",
)
def _lags_hot(spark, sf):
    """The same over many ranges, so that stations are cut into pieces."""
    df = V.readings(spark, sf).select("vd_id", *ORDER, "speed")
    return series.lags(df, ["vd_id"], ORDER, ["speed"], (2,), parts=64).drop("speed")


@query(
    "rolling",
    f"with {V.READINGS_SQL} select vd_id, {big('lane_id')}, {ts('update_time')}, "
    + ", ".join(
        f"{num(f'avg(speed) {_frame(n)}', f'speed_rolling_mean_{n}')},"
        f" {num(f'stddev_samp(speed) {_frame(n)}', f'speed_rolling_std_{n}')},"
        f" {num(f'min(speed) {_frame(n)}', f'speed_rolling_min_{n}')},"
        f" {num(f'max(speed) {_frame(n)}', f'speed_rolling_max_{n}')}"
        for n in _WINDOWS
    )
    + " from readings",
)
def _rolling(spark, sf):
    found = series.rolling(_layout(spark, sf, KEYS), KEYS, ORDER, ["speed"])
    return found.select(*KEYS, *ORDER, *[c for c in found.columns if c.startswith("speed_rolling")])


_SEQ = """seq as (select vd_id, update_time,
    list(speed) over (partition by vd_id order by update_time rows between 11 preceding and current row) as xs,
    list(occupancy) over (partition by vd_id order by update_time rows between 11 preceding and current row) as xo,
    list(speed) over (partition by vd_id order by update_time rows between 1 following and 3 following) as y
  from readings)"""


@query(
    "sequences",
    f"""with {V.READINGS_SQL}, {_SEQ} select vd_id, {ts('update_time')},
    {num('xs[1]', 'first_speed')}, {num('xs[12]', 'last_speed')},
    {num('list_sum(xs) + list_sum(xo)', 'x_sum')}, {num('y[1]', 'y1')}, {num('y[3]', 'y3')}
    from seq where len(xs) = 12 and len(y) = 3""",
)
def _sequences(spark, sf):
    seq = series.sequences(_layout(spark, sf, ["vd_id"]), ["vd_id"], ORDER, ["speed", "occupancy"], "speed")
    x_sum = F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, v: a + v)
    return seq.select(
        "vd_id",
        "update_time",
        F.col("x")[0][0].alias("first_speed"),
        F.col("x")[11][0].alias("last_speed"),
        x_sum.alias("x_sum"),
        F.col("y")[0].alias("y1"),
        F.col("y")[2].alias("y3"),
    )


@query(
    "forecast_label",
    f"""with {V.READINGS_SQL} select vd_id, {big('lane_id')}, {ts('update_time')},
    {num(f'lead(speed, 3) {_W}', 'speed_ahead_3')} from readings""",
)
def _label(spark, sf):
    return series.ahead(_layout(spark, sf, KEYS), KEYS, ORDER, "speed", 3).select(*KEYS, *ORDER, "speed_ahead_3")


@query(
    "forecast_label_timed",
    f"""with {V.TOLLS_SQL} , g as (select etag_pair_id, flow_pos, update_time,
      lead(space_mean_speed_kmh, 1) over w as v, epoch(lead(update_time, 1) over w) - epoch(update_time) as gap
      from tolls window w as (partition by etag_pair_id order by update_time, flow_pos))
    select etag_pair_id, {big('flow_pos')}, {num('case when gap = 300 then v end', 'space_mean_speed_kmh_ahead_1')}
    from g""",
)
def _label_timed(spark, sf):
    """Only labels that really lie one 5-minute step ahead."""
    df = V.tolls(spark, sf).select("etag_pair_id", "update_time", "flow_pos", "space_mean_speed_kmh")
    out = series.ahead(
        df, ["etag_pair_id"], ["update_time", "flow_pos"], "space_mean_speed_kmh", 1, step_minutes=5
    )
    return out.select("etag_pair_id", "flow_pos", "space_mean_speed_kmh_ahead_1")


@query(
    "latest_state",
    f"""with {V.READINGS_SQL}, r as (select *, row_number() over
      (partition by vd_id, lane_id order by update_time desc) as rn from readings)
    select vd_id, {big('lane_id')}, {ts('update_time')}, {num('speed')}, {big('rn', 'recency')}
    from r where rn <= 12""",
)
def _latest(spark, sf):
    df = V.readings(spark, sf).select(*KEYS, *ORDER, "speed")
    return series.latest(df, KEYS, ORDER, 12)


@query(
    "time_split",
    f"""with r as (select event_id, ts, row_number() over (order by ts, event_id) as rn,
      floor(count(*) over () * 0.8) as cut from events)
    select {big('event_id')}, {big('case when rn <= cut then 1 else 0 end', 'is_train')} from r""",
)
def _split(spark, sf):
    df = V.table(spark, sf, "events").select("event_id", "ts")
    return split.chronological_split(df, "ts", "event_id").drop("ts")


@query(
    "time_split_ties",
    """with r as (select l_orderkey, l_shipdate, row_number() over (order by l_shipdate, l_orderkey) as rn,
      floor(count(*) over () * 0.8) as cut from lineitem),
    c as (select l_shipdate, l_orderkey from r where rn = cut)
    select strftime(l.l_shipdate, '%Y-%m-%d') as d, count(*)::bigint as n,
      sum(case when (l.l_shipdate, l.l_orderkey) <= (c.l_shipdate, c.l_orderkey) then 1 else 0 end)::bigint as train_rows
    from lineitem l, c group by 1""",
)
def _split_ties(spark, sf):
    """Day-grained times: the cut falls inside a day, after a tie key."""
    df = V.table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey")
    marked = split.chronological_split(df, "l_shipdate", "l_orderkey")
    return marked.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_train").alias("train_rows")
    )


# --- fused features ---------------------------------------------------------------


def _stored_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The aligned table as its stage stores it, so that it is computed once."""
    return materialize(aligned(spark, sf), "aligned")



def _ratio(a: str, b: str) -> str:
    return f"(case when ({b}) + 1 = 0 then null else ({a})::double / (({b}) + 1) end)"


def _level(c: str) -> str:
    return (
        f"(case when {c} > 0 and {c} <= 40 then 1 when {c} > 40 and {c} <= 60 then 2"
        f" when {c} > 60 and {c} <= 80 then 3 when {c} > 80 and {c} <= 120 then 4 end)"
    )


def _jam(c: str) -> str:
    return f"(greatest(least(100 - {c}, 100), 0) / 100.0::double)"


_FUSED_INT = {
    "hour": "hour(datetime)",
    "day_of_week": "isodow(datetime) - 1",
    "is_weekend": "case when isodow(datetime) >= 6 then 1 else 0 end",
    "is_morning_peak": "case when hour(datetime) between 7 and 9 then 1 else 0 end",
    "is_evening_peak": "case when hour(datetime) between 17 and 19 then 1 else 0 end",
    "is_peak_hour": "case when hour(datetime) between 7 and 9 or hour(datetime) between 17 and 19 then 1 else 0 end",
    "volume_diff": "vd_volume - etag_volume",
    "volume_diff_abs": "abs(vd_volume - etag_volume)",
    "volume_max": "greatest(vd_volume, etag_volume)",
    "region_code": "case region when '圓山' then 1 when '台北' then 2 when '三重' then 3 else 0 end",
    "is_yuanshan": "case when region = '圓山' then 1 else 0 end",
    "is_taipei": "case when region = '台北' then 1 else 0 end",
    "is_sanchong": "case when region = '三重' then 1 else 0 end",
}
_FUSED_NUM = {
    "hour_sin": "sin(2 * pi() * hour(datetime) / 24)",
    "hour_cos": "cos(2 * pi() * hour(datetime) / 24)",
    "speed_diff": "vd_speed - etag_speed",
    "speed_diff_abs": "abs(vd_speed - etag_speed)",
    "speed_diff_ratio": _ratio("vd_speed - etag_speed", "etag_speed"),
    "speed_mean": "(vd_speed + etag_speed) / 2",
    "speed_max": "greatest(vd_speed, etag_speed)",
    "speed_min": "least(vd_speed, etag_speed)",
    "vd_speed_level": _level("vd_speed"),
    "etag_speed_level": _level("etag_speed"),
    "volume_diff_ratio": _ratio("vd_volume - etag_volume", "etag_volume"),
    "volume_mean": "(vd_volume + etag_volume) / 2.0::double",
    "vd_density": _ratio("vd_volume", "vd_speed"),
    "etag_density": _ratio("etag_volume", "etag_speed"),
    "density_ratio": _ratio(_ratio("vd_volume", "vd_speed"), _ratio("etag_volume", "etag_speed")),
    "vd_congestion": _jam("vd_speed"),
    "etag_congestion": _jam("etag_speed"),
    "congestion_mean": f"({_jam('vd_speed')} + {_jam('etag_speed')}) / 2",
    "vd_efficiency": _ratio("vd_speed", "vd_volume"),
    "etag_efficiency": _ratio("etag_speed", "etag_volume"),
    "efficiency_ratio": _ratio(_ratio("vd_speed", "vd_volume"), _ratio("etag_speed", "etag_volume")),
    "occupancy_speed_ratio": _ratio("vd_occupancy", "vd_speed"),
    "occupancy_volume_ratio": _ratio("vd_occupancy", "vd_volume"),
}
_LAG_NAMES = [f"{t}_lag_{p}" for p in (1, 2) for t in ft.FUSED_LAGGED]


def _fused_sql(part: str) -> str:
    plain = ", ".join(f"{e} as {n}" for n, e in {**_FUSED_INT, **_FUSED_NUM}.items())
    lag = ", ".join(
        f"case when day_n <= 2 then 0 else coalesce(lag({t}, {p}) over w, 0) end as {t}_lag_{p}"
        for p in (1, 2)
        for t in ft.FUSED_LAGGED
    )
    return f"""{V.ALIGNED_SQL},
  rowwise as (select *, count(*) over (partition by date) as day_n, {plain} from aligned),
  fused as (select *, {lag} from rowwise
    window w as (partition by {part} order by datetime, flow_pos))"""


_FUSED_OUT = (
    f"{day()}, {ts('datetime')}, region, etag_pair, {big('flow_pos')}, "
    + ", ".join(big(n) for n in _FUSED_INT)
    + ", "
    + ", ".join(num(n) for n in [*_FUSED_NUM, *_LAG_NAMES])
)
_FUSED_COLS = ["date", "datetime", "region", "etag_pair", "flow_pos", *_FUSED_INT, *_FUSED_NUM, *_LAG_NAMES]


@query(
    "fusion_features",
    f"with {_fused_sql('date, region, etag_pair')} select {_FUSED_OUT} from fused",
)
def _fused(spark, sf):
    return ft.fused_features(_stored_alignment(spark, sf)).select(*_FUSED_COLS)


@query(
    "fusion_features_by_vehicle",
    f"with {_fused_sql('date, region, etag_pair, vehicle_type_code')} select {day()}, region, etag_pair,"
    f" {big('flow_pos')}, " + ", ".join(num(n) for n in _LAG_NAMES) + " from fused",
)
def _fused_vehicle(spark, sf):
    out = ft.fused_features(_stored_alignment(spark, sf), by_vehicle=True)
    return out.select("date", "region", "etag_pair", "flow_pos", *_LAG_NAMES)


_ZERO = ["hour_sin", "volume_mean", *_LAG_NAMES]


@query(
    "fusion_features_complete",
    f"with {_fused_sql('date, region, etag_pair')} select {ts('datetime')}, region, "
    + ", ".join(big(n) for n in _FUSED_INT)
    + ", "
    + ", ".join("0.0::double as " + n if n in _ZERO else num(n) for n in [*_FUSED_NUM, *_LAG_NAMES])
    + " from fused",
)
def _fused_complete(spark, sf):
    """A table lacking some features gets them as 0.0 and keeps the core set."""
    slim = ft.fused_row_features(aligned(spark, sf)).drop("hour_sin", "volume_mean")
    return ft.complete_columns(slim, list(ft.FUSED_CORE)).select("datetime", "region", *ft.FUSED_CORE)


# --- station features ---------------------------------------------------------------

_WORK = "isodow(update_time) < 6"
_STATION = {
    "hour": ("i", "hour(update_time)"),
    "minute": ("i", "minute(update_time)"),
    "day_of_week": ("i", "isodow(update_time) - 1"),
    "is_weekend": ("i", "case when isodow(update_time) >= 6 then 1 else 0 end"),
    "hour_sin": ("n", "sin(2 * pi() * hour(update_time) / 24)"),
    "minute_cos": ("n", "cos(2 * pi() * minute(update_time) / 60)"),
    "day_sin": ("n", "sin(2 * pi() * (isodow(update_time) - 1) / 7)"),
    "is_morning_peak": ("i", f"case when hour(update_time) in (7, 8) and {_WORK} then 1 else 0 end"),
    "is_evening_peak": ("i", f"case when hour(update_time) in (17, 18, 19) and {_WORK} then 1 else 0 end"),
    "is_yuanshan": ("i", "case when contains(vd_id, '圓山') or contains(vd_id, '23') then 1 else 0 end"),
    "is_taipei": ("i", "case when contains(vd_id, '台北') or contains(vd_id, '25') then 1 else 0 end"),
    "is_sanchong": ("i", "case when contains(vd_id, '三重') or contains(vd_id, '27') then 1 else 0 end"),
    "speed_lag_1": ("n", f"lag(speed, 1) {_W}"),
    "speed_rolling_mean_3": ("n", f"avg(speed) {_frame(3)}"),
    "speed_rolling_std_12": ("n", f"stddev_samp(speed) {_frame(12)}"),
    "speed_occupancy_ratio": ("n", "speed / (occupancy + 1)"),
    "speed_occupancy_product": ("n", "speed * occupancy"),
    "volume_density": ("n", "volume_total / (occupancy + 1.0::double)"),
    "small_car_ratio": ("n", "volume_small / (volume_total + 1.0::double)"),
    "large_car_ratio": ("n", "volume_large / (volume_total + 1.0::double)"),
    "truck_ratio": ("n", "volume_truck / (volume_total + 1.0::double)"),
    "peak_volume_interaction": (
        "i",
        f"case when hour(update_time) in (7, 8, 17, 18, 19) and {_WORK} then volume_total else 0 end",
    ),
    "speed_ahead_3": ("n", f"lead(speed, 3) {_W}"),
}


@query(
    "station_features",
    f"""with {V.READINGS_SQL}, ids as (select vd_id, row_number() over (order by vd_id) - 1 as code
      from (select distinct vd_id from readings))
    select vd_id, {big('lane_id')}, {ts('update_time')}, {big('code', 'vd_encoded')}, """
    + ", ".join((big if k == "i" else num)(e, n) for n, (k, e) in _STATION.items())
    + " from readings join ids using (vd_id)",
)
def _station(spark, sf):
    encoding = ft.station_encoding(V.readings(spark, sf))
    out = ft.station_features(_layout(spark, sf, KEYS), encoding=encoding, horizon=3)
    return out.select("vd_id", "lane_id", "update_time", "vd_encoded", *_STATION)


@query(
    "station_encoding",
    f"""with {V.LANES_SQL} select vd_id, {big('row_number() over (order by vd_id) - 1', 'vd_encoded')}
    from (select distinct vd_id from lanes)""",
)
def _encoding(spark, sf):
    return ft.station_encoding(V.lanes(spark, sf))


# --- selection and scaling ------------------------------------------------------------

def _fused_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, since selection and scaling read it more than once."""
    return materialize(ft.fused_features(_stored_alignment(spark, sf)), "fused")


_ALL = [c for c in [*ft.FUSED_REQUIRED, *_FUSED_INT, *_FUSED_NUM, *_LAG_NAMES] if c != "speed_mean"]
_PAIRS = [(a, b) for i, a in enumerate(_ALL) for b in _ALL[i + 1 :]]


def _listed(values) -> str:
    return "unnest([" + ", ".join(values) + "])"


def _corr_sql(a: str, b: str) -> str:
    """Null for a constant column, where the quotient of rounding errors means nothing."""
    x, y = f"coalesce({a}, 0)::double", f"coalesce({b}, 0)::double"
    return f"case when min({x}) < max({x}) and min({y}) < max({y}) then corr({x}, {y}) end"


@query(
    "corr_pairs",
    f"with {_fused_sql('date, region, etag_pair')}, c as (select "
    + _listed(f"'{a}'" for a, _ in _PAIRS)
    + " as feature_a, "
    + _listed(f"'{b}'" for _, b in _PAIRS)
    + " as feature_b, "
    + _listed(_corr_sql(a, b) for a, b in _PAIRS)
    + f" as r from fused) select feature_a, feature_b, {num('r')} from c",
)
def _corr(spark, sf):
    """All candidate features."""
    return select.correlation_pairs(_fused_rows(spark, sf), _ALL)


@query(
    "f_scores",
    f"with {_fused_sql('date, region, etag_pair')}, c as (select "
    + _listed(f"'{c}'" for c in _ALL)
    + " as feature, "
    + _listed(_corr_sql(c, "speed_mean") for c in _ALL)
    + f" as r, count(*) as n from fused) select feature, {num('r')},"
    + f" {num('r * r / (1 - r * r) * (n - 2)', 'f_score')} from c",
)
def _f_scores(spark, sf):
    """All candidate features."""
    return select.f_scores(_fused_rows(spark, sf), _ALL, "speed_mean")


@query(
    "zscore_first_day",
    f"with {_fused_sql('date, region, etag_pair')}, s as (select "
    + ", ".join(f"avg(coalesce({c}, 0)) as m_{c}, stddev_pop(coalesce({c}, 0)) as s_{c}" for c in _ALL)
    + " from fused where date = (select min(date) from fused))"
    + f" select {day()}, region, etag_pair, {big('flow_pos')}, {num('speed_mean')}, "
    + ", ".join(
        num(f"(coalesce({c}, 0) - m_{c}) / (case when s_{c} = 0 then 1 else s_{c} end)", c) for c in _ALL
    )
    + " from fused, s",
)
def _zscore(spark, sf):
    """Statistics of the first day, applied to every day and candidate feature."""
    rows = _fused_rows(spark, sf)
    first = rows.agg(F.min("date")).first()[0]
    frozen = select.fit_scaler(rows.where(F.col("date") == F.lit(first)), _ALL, "speed_mean")
    return frozen.transform(rows, ("date", "region", "etag_pair", "flow_pos"))


@query(
    "fused_quality",
    f"""with {_fused_sql('date, region, etag_pair')}, q as (select date, count(*) as n,
      avg(case when {' and '.join(f'{c} is not null' for c in [*_ALL, 'speed_mean'])}
          then 1 else 0 end) * 100 as done,
      stddev_samp(speed_mean) as sd, max(speed_mean) - min(speed_mean) as rng,
      [{', '.join(f'stddev_samp({c})' for c in _ALL)}] as sds
      from fused group by date),
    p as (select *, list_filter(sds, lambda x: x is not null) as kept from q),
    v as (select *, case when len(kept) > 0 then list_sum(kept) / len(kept) end as var from p)
    select {day()}, {big('n', 'record_count')}, {len(_ALL)}::bigint as feature_count,
      {num('done', 'data_completeness')}, {num('sd', 'target_std')}, {num('rng', 'target_range')},
      {num('var', 'feature_variance')},
      {big('len(list_filter(kept, lambda x: x < 0.01))', 'low_variance_features')},
      {num('least(30, done * 0.3) + least(25, n / 100.0 * 25) + 20.0 + least(15, coalesce(sd, 0) / 10 * 15)'
           ' + least(10, coalesce(var, 0) * 100)', 'quality_score')} from v""",
)
def _fused_quality(spark, sf):
    rows = _fused_rows(spark, sf).select("date", "speed_mean", *_ALL)
    return select.fused_quality(rows, _ALL, "speed_mean", ["date"])


@query(
    "fused_label_15min",
    f"""with {V.ALIGNED_SQL}, later as (select region, etag_pair, vehicle_type_code, datetime,
      arg_min((vd_speed + etag_speed) / 2, flow_pos) as v from aligned group by all)
    select {day('a.date', 'date')}, {ts('a.datetime', 'datetime')}, a.region, a.etag_pair, a.vehicle_type_code,
      {big('a.flow_pos', 'flow_pos')}, {num('l.v', 'speed_mean_in_15_min')}
    from aligned a left join later l on l.region is not distinct from a.region and l.etag_pair is not distinct from a.etag_pair
      and l.vehicle_type_code is not distinct from a.vehicle_type_code and l.datetime = a.datetime + interval 15 minutes""",
)
def _label_15(spark, sf):
    """The label of the fused models: the mean speed of the same key 15 minutes later."""
    rows = _stored_alignment(spark, sf).withColumn("speed_mean", (F.col("vd_speed") + F.col("etag_speed")) / 2)
    keys = ["region", "etag_pair", "vehicle_type_code"]
    out = series.later(rows, keys, "datetime", "speed_mean", 15, ["flow_pos"])
    return out.select("date", "datetime", *keys, "flow_pos", "speed_mean_in_15_min")


_CAND = [*_ALL, "time_diff_min"]
_CAND_PAIRS = [(i, j) for i in range(len(_CAND)) for j in range(i + 1, len(_CAND))]


@query(
    "selected_features",
    f"with {_fused_sql('date, region, etag_pair')}, c as (select "
    + _listed(str(j) for _, j in _CAND_PAIRS)
    + " as j, "
    + _listed(_corr_sql(_CAND[i], _CAND[j]) for i, j in _CAND_PAIRS)
    + " as r from fused), n as (select "
    + _listed(f"'{c}'" for c in _CAND)
    + " as feature, "
    + _listed(str(i) for i in range(len(_CAND)))
    + " as pos, "
    + _listed(_corr_sql(c, "speed_mean") for c in _CAND)
    + f""" as r, count(*) as n from fused),
    k as (select *, row_number() over (order by r * r / (1 - r * r) * (n - 2) desc nulls last, pos) as best
      from n where pos not in (select j from c where abs(r) > {select.CORRELATION_LIMIT}))
    select {big('row_number() over (order by pos)', 'position')}, feature from k where best <= 15""",
)
def _selected(spark, sf):
    """Candidates of the fused table, minus near-duplicates, the 15 best by F."""
    wide = _fused_rows(spark, sf).select(*ft.FUSED_KEYS, ft.FUSED_TARGET, *_CAND)
    names = select.select_features(wide, k=15)
    rows = list(enumerate(names, 1))
    return spark.createDataFrame(rows, "position int, feature string")


@query("fused_table")
def _fused_table(spark, sf):
    """Selection and scaling frozen on the first day, all days transformed in one job."""
    wide = materialize(ft.fused_features(_stored_alignment(spark, sf)), "fused")
    return select.fit_on_first_day(wide).transform(wide)


_FROZEN_SQL = f"""with {_fused_sql('date, region, etag_pair')}, days as (select date, count(*) as n from fused group by date),
    first as (select * from fused where date = (select coalesce(min(date) filter (n >= 3), min(date)) from days)),
    c as (select {_listed(str(j) for _, j in _CAND_PAIRS)} as j,
      {_listed(_corr_sql(_CAND[i], _CAND[j]) for i, j in _CAND_PAIRS)} as r from first),
    n as (select {_listed(f"'{c}'" for c in _CAND)} as feature, {_listed(str(i) for i in range(len(_CAND)))} as pos,
      {_listed(f'avg(coalesce({c}, 0)::double)' for c in _CAND)} as mean,
      {_listed(f'stddev_pop(coalesce({c}, 0)::double)' for c in _CAND)} as sd,
      {_listed(_corr_sql(c, 'speed_mean') for c in _CAND)} as r, count(*) as n from first),
    k as (select *, row_number() over (order by r * r / (1 - r * r) * (n - 2) desc nulls last, pos) as best
      from n where pos not in (select j from c where abs(r) > {select.CORRELATION_LIMIT})),
    v as (select date, datetime, region, etag_pair, flow_pos, {_listed(f"'{c}'" for c in _CAND)} as feature,
      {_listed(f'coalesce({c}, 0)::double' for c in _CAND)} as value from fused)
    select {day()}, {ts('datetime')}, region, etag_pair, {big('flow_pos')}, feature,
      {num('(value - mean) / (case when sd = 0 then 1 else sd end)', 'scaled')}
    from v join k using (feature) where best <= 15"""


@query("fused_table_rows", _FROZEN_SQL)
def _fused_table_rows(spark, sf):
    """The frozen fused table, a row for each feature: selection and scaling of the first usable day on all days."""
    wide = _fused_rows(spark, sf).select(*ft.FUSED_KEYS, ft.FUSED_TARGET, *_CAND)
    frozen = select.fit_on_first_day(wide)
    table = frozen.transform(wide)
    keys = ["date", "datetime", "region", "etag_pair", "flow_pos"]
    return table.unpivot(keys, list(frozen.names), "feature", "scaled")



# --- metrics on fixed predictors ------------------------------------------------------


def _predictors(spark: SparkSession, sf: str) -> DataFrame:
    """Two simple forecasts of a lane's next speed: last value, mean of the last three."""
    df = V.readings(spark, sf).select(*KEYS, *ORDER, "speed")

    def build(w):
        return {
            "last": F.lag("speed", 1).over(w),
            "mean3": F.avg("speed").over(w.rowsBetween(-3, -1)),
        }

    out = series.over_rows(df, KEYS, ORDER, ["speed"], build, before=3)
    return out.where(F.col("last").isNotNull())


_PRED = f"""{V.READINGS_SQL}, pred as (select * from (select vd_id, lane_id, update_time, speed,
    lag(speed, 1) {_W} as last, avg(speed) over (partition by vd_id, lane_id order by update_time
      rows between 3 preceding and 1 preceding) as mean3 from readings) where last is not null),
  long as (select speed as y, 'last' as model, last as p from pred
    union all select speed, 'mean3', mean3 from pred),
  scored as (select model, count(*) as n, sqrt(avg((y - p) * (y - p))) as rmse,
    avg(abs(y - p)) as mae, 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) as r2,
    avg(abs((y - p) / (y + 1e-8::double))) * 100 as mape,
    avg(case when abs((y - p) / (y + 1e-8::double)) * 100 <= 10 then 1 else 0 end) * 100 as hit
    from long group by model)"""


@query(
    "model_metrics",
    f"""with {_PRED} select model, {big('n')}, {num('rmse')}, {num('mae')}, {num('r2')}, {num('round(mape, 2)', 'mape')},
    {num('hit', 'accuracy_rate')}, case when r2 > 0.8 then 'excellent' when r2 > 0.7 then 'good'
      when r2 > 0.5 then 'acceptable' else 'insufficient' end as r2_band,
    {big('row_number() over (order by r2 desc, model)', 'rank')} from scored""",
)
def _metrics(spark, sf):
    scored = metrics.model_metrics(_predictors(spark, sf), "speed", ["last", "mean3"])
    # near-zero speeds make mape huge, beyond six exact decimals
    return metrics.rank_models(scored).withColumn("mape", F.round("mape", 2))


_LANE = "partition by vd_id, lane_id order by update_time"


@query(
    "model_bands",
    f"""with {V.SNAPSHOTS_SQL}, p as (select vd_id, speed::double as y, lag(speed) over ({_LANE})::double as last,
      avg(speed) over ({_LANE} rows between 3 preceding and 1 preceding) as mean3 from snapshots),
    l as (select vd_id, 'last' as model, y, last as p from p union all select vd_id, 'mean3', y, mean3 from p),
    m as (select vd_id, model, count(*) as n, 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) as r2,
      avg(case when abs((y - p) / (y + 1e-8)) * 100 <= 10 then 1.0::double else 0 end) * 100 as hit
      from l where y is not null and p is not null group by all)
    select vd_id, model, {big('n')}, {num('r2')}, {num('hit', 'accuracy_rate')},
      case when r2 > 0.8 and hit > 80 then 'excellent' when r2 > 0.7 and hit > 70 then 'good' else 'needs work' end as accuracy,
      case when r2 > 0.9 then 'excellent' when r2 > 0.8 then 'good' else 'needs work' end as tuning,
      case when r2 > 0.8 then 'excellent' when r2 > 0.7 then 'good' when r2 > 0.5 then 'acceptable'
        else 'insufficient' end as r2_band from m""",
)
def _model_bands(spark, sf):
    """Bands of the metrics that two predictors reach at each detector."""
    def build(w):
        return {"last": F.lag("speed").over(w), "mean3": F.avg("speed").over(w.rowsBetween(-3, -1))}

    rows = series.over_rows(V.snapshots(spark, sf).select(*KEYS, *ORDER, "speed"), KEYS, ORDER, ["speed"], build, before=3)
    scored = metrics.model_metrics(rows, "speed", ["last", "mean3"], ["vd_id"])
    return scored.select(
        "vd_id",
        "model",
        "n",
        "r2",
        "accuracy_rate",
        accuracy_band(F.col("r2"), F.col("accuracy_rate")).alias("accuracy"),
        tuning_band(F.col("r2")).alias("tuning"),
        "r2_band",
    )


@query(
    "best_model",
    f"with {_PRED} select arg_max(model, r2) as best_model, {num('max(r2)', 'best_r2')} from scored",
)
def _best(spark, sf):
    return metrics.best_model(
        metrics.model_metrics(_predictors(spark, sf), "speed", ["last", "mean3"])
    )


@query(
    "ensemble_by_r2",
    f"""with {_PRED}, w as (select greatest(0, max(r2) filter (model = 'last')) as wa,
      greatest(0, max(r2) filter (model = 'mean3')) as wb from scored)
    select vd_id, {big('lane_id')}, {ts('update_time')},
      {num('case when wa + wb > 0 then (last * wa + mean3 * wb) / (wa + wb) else (last + mean3) / 2 end',
           'ensemble')} from pred, w""",
)
def _blend(spark, sf):
    out = metrics.blend_by_r2(_predictors(spark, sf), "speed", "last", "mean3")
    return out.select(*KEYS, *ORDER, "ensemble")


@query(
    "ensemble_fixed",
    f"""with {_PRED} select vd_id, {big('lane_id')}, {ts('update_time')},
    {num('last * 0.7::double + mean3 * 0.3::double', 'ensemble')}, 92::bigint as confidence_ensemble
    from pred""",
)
def _blend_fixed(spark, sf):
    out = metrics.blend_fixed(_predictors(spark, sf), "last", "mean3")
    return out.select(*KEYS, *ORDER, "ensemble", "confidence_ensemble")


_CONF = "((round(last::decimal(18, 6), 1)::double * 85 + round(mean3::decimal(18, 6), 1)::double * 80) / 165)"


@query(
    "ensemble_by_confidence",
    f"""with {_PRED}, c as (select *, {_CONF} as m from pred)
    select vd_id, {big('lane_id')}, {ts('update_time')},
    case when m >= 80 then '暢通🟢' when m >= 50 then '緩慢🟡' else '擁堵🔴' end as traffic_status,
    85::bigint as confidence, 2::bigint as models_used, {num('round(m, 1)', 'predicted_speed')} from c""",
)
def _blend_confidence(spark, sf):
    conf = {"last": C.STATION_CONFIDENCE["gbt"], "mean3": C.STATION_CONFIDENCE["random_forest"]}
    out = metrics.blend_by_confidence(_predictors(spark, sf), conf)
    return out.select(*KEYS, *ORDER, "traffic_status", "confidence", "models_used", "predicted_speed")


_GRID = ", ".join(f"({a}::double, {b}::double)" for a, b in C.WEIGHT_GRID)


@query(
    "weight_search",
    f"""with {_PRED}, g as (select wa, wb, speed as y, last * wa + mean3 * wb as p
      from pred, (values {_GRID}) w(wa, wb)),
    s as (select wa, wb, 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) as r2 from g group by all)
    select {num('wa', 'weight_a')}, {num('wb', 'weight_b')}, {num('r2')},
      {big('case when r2 = max(r2) over () then 1 else 0 end', 'is_best')} from s""",
)
def _weights(spark, sf):
    return metrics.weight_search(_predictors(spark, sf), "speed", "last", "mean3")


# --- streams ------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = V.table(spark, sf, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )


_SERVED = "(contains(vd_id, '圓山') or contains(vd_id, '台北') or contains(vd_id, '三重'))"
_CLOSED = f"""closed as (select b.* from bins b where bin + interval 5 minutes
    <= (select max(update_time) from readings where {_SERVED}) - interval 10 minutes)"""


@query(
    "stream_bins",
    f"""with {V.READINGS_SQL}, {V.bins_sql('readings')}, {_CLOSED}
    select region, {ts('bin')}, {num('vd_speed')}, {big('vd_volume')}, {num('vd_occupancy')} from closed""",
)
def _stream_bins(spark, sf):
    """Watermarked bins; those still open at the end of the input are not emitted."""
    out, check = scratch_path(spark, "bins"), scratch_path(spark, "bins-check")
    vd = V.readings_of(_event_stream(spark, sf))
    jobs.write_available(jobs.bins(vd).drop("bin_time"), out, check)
    return spark.read.parquet(out)


@query(
    "stream_align",
    f"""with {V.ALIGNED_SQL}, ends as (select least(
      (select max(update_time) from readings where {_SERVED}), (select max(update_time) from tolls))
      - interval 10 minutes as seen)
    select {day()}, {ts('datetime')}, region, etag_pair, {num('vd_speed')}, {big('vd_volume')},
      {num('vd_occupancy')}, {num('etag_speed')}, {big('etag_volume')}, {num('time_diff_min')},
      vehicle_type_code, {big('flow_pos')} from aligned, ends
    where time_bucket(interval 5 minutes, datetime + interval 150 seconds) + interval 5 minutes <= seen""",
)
def _stream_align(spark, sf):
    """Stream-stream alignment; rows whose bin is still open at the end are not emitted."""
    out, check = scratch_path(spark, "align"), scratch_path(spark, "align-check")
    joined = jobs.aligned(V.readings_of(_event_stream(spark, sf)), V.tolls_of(_event_stream(spark, sf)))
    jobs.write_available(joined, out, check)
    return spark.read.parquet(out)


@query(
    "stream_ingest",
    f"""with {V.READINGS_SQL} select {day()}, {big('count(*)', 'n')}, {big('sum(occupancy)', 'occupancy')}
    from readings where contains(vd_id, '圓山') or contains(vd_id, '台北') or contains(vd_id, '三重')
      or contains(vd_id, 'N1-N-2') or contains(vd_id, 'N1-S-2') or (contains(vd_id, 'N1')
      and len(list_filter(string_split(vd_id, '-'), lambda p: try_cast(p as int) between 20 and 30)) > 0)
    group by date""",
)
def _stream_ingest(spark, sf):
    """Snapshot documents as a stream, parsed and appended to the lane table once."""
    table, check = scratch_path(spark, "lanes"), scratch_path(spark, "lanes-check")
    docs = vd_xml(V.readings_of(_event_stream(spark, sf)))
    lanes = documents.parse_vd(docs).drop("file_name")
    jobs.run_available(lanes, lambda df, _: tables.write_lane_days(df, table), check)
    return (
        tables.load_days(spark, table)
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("occupancy").alias("occupancy"))
    )


@query(
    "stream_day_summary",
    f"""with {V.READINGS_SQL} select {day()}, {big('count(*)', 'total_records')},
    {big("count(*) filter (contains(time_category, '尖峰'))", 'peak_records')},
    {big("count(*) filter (not contains(time_category, '尖峰'))", 'offpeak_records')},
    {num('avg(speed)', 'avg_speed')}, {num('avg(volume_total)', 'avg_volume')},
    {big('count(distinct vd_id)', 'unique_vd_count')} from readings group by date""",
)
def _stream_days(spark, sf):
    stored, out, check = (scratch_path(spark, n) for n in ("rows", "days", "days-check"))
    vd = V.readings_of(_event_stream(spark, sf))
    jobs.run_available(vd, jobs.update_day_summary(stored, out), check)
    return spark.read.parquet(out)
