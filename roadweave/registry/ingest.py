"""Both feeds written as real files, ingested over two runs, and read back from their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.operators import summary
from roadweave.registry import views as V
from roadweave.registry.base import big, day, num, query, ts
from roadweave.session import scratch_path
from roadweave.sources import tables
from roadweave.streaming import jobs

DAY_MS = 86_400_000


class Folder:
    """Files of a store that Spark reaches, named and dated from the driver; one per date."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path
        self.java = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.java.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.java.Path(f"{self.root}/{name}")

    def write(self, docs: DataFrame, compression: str = "none") -> dict[str, object]:
        """One file for each value of ``d``: its path as Spark's writer left it."""
        docs.repartition("d").write.partitionBy("d").option("compression", compression).text(self.root)
        out = {}
        for folder in self.fs.listStatus(self.java.Path(self.root)):
            if folder.isDirectory():
                for f in self.fs.listStatus(folder.getPath()):
                    if f.getPath().getName().startswith("part-"):
                        out[folder.getPath().getName().removeprefix("d=")] = f.getPath()
        return out

    def move(self, source, name: str, days_old: int = 0) -> None:
        """Put a file into place, last changed so many days ago."""
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        self.fs.rename(source, target)
        if days_old:
            when = self.fs.getFileStatus(target).getModificationTime() - days_old * DAY_MS
            self.fs.setTimes(target, when, -1)

    def put(self, name: str, text: str) -> None:
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(target)
        stream.write(bytearray(text, "utf-8"))
        stream.close()


def _text(c: str):
    return F.col(c).cast("string")


def _vd_days(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot document for each date with all its stations and lanes: (d, content)."""
    figures = ["speed", "occupancy", "volume_small", "volume_large", "volume_truck", "speed_small", "speed_large", "speed_truck"]
    lanes = V.readings(spark, sf).groupBy("date", "vd_id", "lane_id").agg(
        *[F.floor(F.max(c)).cast("string").alias(c) for c in figures]
    )

    def vehicle(code, kind):
        volume, speed = F.col(f"volume_{kind}"), F.col(f"speed_{kind}")
        return F.struct(F.lit(code).alias("VehicleType"), volume.alias("Volume"), speed.alias("Speed"))

    three = F.array(vehicle("S", "small"), vehicle("L", "large"), vehicle("T", "truck"))
    lane = F.struct(
        _text("lane_id").alias("LaneID"),
        F.lit("1").alias("LaneType"),
        F.col("speed").alias("Speed"),
        F.col("occupancy").alias("Occupancy"),
        F.struct(three.alias("Vehicle")).alias("Vehicles"),
    )
    stations = lanes.groupBy("date", "vd_id").agg(F.collect_list(lane).alias("Lane"))
    live = F.struct(F.col("vd_id").alias("VDID"), F.col("Lane"))
    days = stations.groupBy("date").agg(F.collect_list(live).alias("VDLive"))
    time = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T08:00:00+08:00"))
    doc = F.struct(time.alias("UpdateTime"), "VDLive")
    return days.select(F.date_format("date", "yyyyMMdd").alias("d"), F.to_xml(doc, {"rowTag": "VDLiveList"}).alias("content"))


_SERVED = """(contains(vd_id, '圓山') or contains(vd_id, '台北') or contains(vd_id, '三重')
  or contains(vd_id, 'N1-N-2') or contains(vd_id, 'N1-S-2') or (contains(vd_id, 'N1')
  and len(list_filter(string_split(vd_id, '-'), lambda p: try_cast(p as int) between 20 and 30)) > 0))"""


@query(
    "vd_files_ingest",
    f"""with {V.READINGS_SQL} select {ts("date + interval 8 hours", 'update_time')}, vd_id, {big('lane_id')},
    {big('floor(max(speed))', 'speed')}, {big('max(occupancy)', 'occupancy')}, {big('max(volume_small)', 'volume_small')},
    {big('max(volume_small) + max(volume_large) + max(volume_truck)', 'volume_total')},
    {big('floor(max(speed_truck))', 'speed_truck')}
    from readings where {_SERVED} group by date, vd_id, lane_id""",
)
def _vd_files(spark, sf):
    """Files of two runs, among them old ones, a broken one and a name that was seen before."""
    made = Folder(spark, scratch_path(spark, "vd-made")).write(_vd_days(spark, sf))
    raw, table, check, ledger = (scratch_path(spark, n) for n in ("vd-raw", "vd-table", "vd-check", "vd-ledger"))
    folder, days = Folder(spark, raw), sorted(made)
    half = len(days) // 2
    for i, d in enumerate(days[:half]):
        folder.move(made[d], f"{d[:4]}/VD_{d}.xml", days_old=20 * (i % 2))
    folder.put("2020/VD_broken.xml", "<VDLiveList><VDLive><VDID>cut off")
    folder.put("2020/notes.xml", "<x/>")
    jobs.ingest_vd(spark, raw, table, check, max_files=5, ledger=ledger)
    for i, d in enumerate(days[half:]):
        folder.move(made[d], f"late/{d[4:6]}/VD_{d}.xml", days_old=40 * (i % 2))
    if half:
        again = "<VDLiveList><UpdateTime>2030-01-01T00:00:00+08:00</UpdateTime><VDLive><VDID>VD-N1-N-23-圓山</VDID></VDLive></VDLiveList>"
        folder.put(f"again/VD_{days[0]}.xml", again)
    jobs.ingest_vd(spark, raw, table, check, max_files=5, ledger=ledger)
    return tables.load_days(spark, table).select(
        "update_time", "vd_id", "lane_id", "speed", "occupancy", "volume_small", "volume_total", "speed_truck"
    )


def _etag_days(spark: SparkSession, sf: str) -> DataFrame:
    """A gantry document for each date, flows by pair: (d, content)."""
    raw = V.raw_tolls_of(V.table(spark, sf, "events"))
    flow = F.struct(
        F.col("vehicle_type_code").alias("VehicleType"),
        _text("travel_time_seconds").alias("TravelTime"),
        _text("standard_deviation").alias("StandardDeviation"),
        _text("space_mean_speed_kmh").alias("SpaceMeanSpeed"),
        _text("vehicle_count").alias("VehicleCount"),
    )
    by_pair = raw.withColumn("d", F.date_format("update_time", "yyyyMMdd")).groupBy("d", "etag_pair_id")
    pairs = by_pair.agg(F.struct(F.sort_array(F.collect_list(flow)).alias("Flow")).alias("Flows"))
    pair = F.struct(F.col("etag_pair_id").alias("ETagPairId"), "Flows")
    days = pairs.groupBy("d").agg(F.struct(F.collect_list(pair).alias("ETagPairLive")).alias("ETagPairLives"))
    doc = F.struct(F.lit("2020-01-01T00:00:00+08:00").alias("UpdateTime"), "ETagPairLives")
    return days.select("d", F.to_xml(doc, {"rowTag": "ETagPairLiveList"}).alias("content"))


@query(
    "etag_files_ingest",
    f"""with {V.TOLLS_SQL} select {ts("date_trunc('day', update_time) + interval 495 minutes", 'update_time')},
    etag_pair_id, vehicle_type_name, {big('travel_time_seconds')}, {big('vehicle_count')},
    {num('space_mean_speed_kmh')}, {num('standard_deviation')}, {big('data_valid')} from tolls""",
)
def _etag_files(spark, sf):
    """Compressed files in dated folders over two runs; names repeat daily, one file is old."""
    made = Folder(spark, scratch_path(spark, "etag-made")).write(_etag_days(spark, sf), "gzip")
    raw, table, check = (scratch_path(spark, n) for n in ("etag-raw", "etag-table", "etag-check"))
    folder, days = Folder(spark, raw), sorted(made)
    half = len(days) // 2
    for run in (days[:half], days[half:]):
        for i, d in enumerate(run):
            folder.move(made[d], f"ETag_Data_{d}/ETagPairLive_0815.xml.gz", days_old=30 * (i % 2))
        folder.put("ETag_Data_abc/ETagPairLive_0000.xml", "not of a date")
        jobs.ingest_etag(spark, raw, table, check, max_files=7)
    return tables.load_days(spark, table).select(
        "update_time", "etag_pair_id", "vehicle_type_name", "travel_time_seconds", "vehicle_count",
        "space_mean_speed_kmh", "standard_deviation", "data_valid",
    )


# --- files as they lie in a store ---------------------------------------------------------

_EXTRA, _FEWER = "purchase", "signup"


@query(
    "file_drift",
    f"""with t as (select event_type, count(*) as n from events group by event_type),
      c as (select *, case event_type when '{_EXTRA}' then 7 when '{_FEWER}' then 5 else 6 end as columns from t)
    select event_type as file, {big('columns', 'column_count')},
      {big('(select mode(columns) from c where columns = 6)', 'modal_count')},
      case when columns = 7 then 'note' else '' end as extra_columns,
      case when columns = 5 then 'props' else '' end as missing_columns, 1::bigint as has_size from c""",
)
def _file_drift(spark, sf):
    """Stored files, one for each kind of event, some with a column more or less: their footers are compared."""
    path = scratch_path(spark, "drift")
    events = V.table(spark, sf, "events")
    for r in events.select("event_type").distinct().collect():  # a handful of kinds
        kind = r.event_type
        rows = events.where(F.col("event_type") == kind)
        rows = rows.withColumn("note", F.lit("x")) if kind == _EXTRA else rows.drop("props") if kind == _FEWER else rows
        rows.coalesce(1).write.parquet(f"{path}/{kind}")
    found = tables.flag_schema_drift(tables.file_schemas(spark, path))
    return found.select(
        F.element_at(F.split("file", "/"), -2).alias("file"),
        "column_count",
        "modal_count",
        F.concat_ws(",", "extra_columns").alias("extra_columns"),
        F.concat_ws(",", "missing_columns").alias("missing_columns"),
        (F.col("size") > 0).cast("long").alias("has_size"),
    )


@query(
    "stored_file_counts",
    f"""with {V.READINGS_SQL} select {day()}, {big('count(distinct lane_id)', 'files')}, {big('count(*)', 'records')},
      1::bigint as size_agrees from readings group by date""",
)
def _stored_counts(spark, sf):
    """Files, rows and size of each date of a table that was appended to once for each lane number."""
    path = scratch_path(spark, "files")
    rows = V.readings(spark, sf).cache()
    for i in range(4):
        rows.where(F.col("lane_id") == i).coalesce(1).write.mode("append").partitionBy("date").parquet(path)
    rows.unpersist()
    folder = Folder(spark, path)
    sizes = [
        (f.getPath().getName().removeprefix("date="), folder.fs.getContentSummary(f.getPath()).getLength())
        for f in folder.fs.listStatus(folder.java.Path(path))
        if f.isDirectory()
    ]  # a folder a date
    real = spark.createDataFrame(sizes, "d string, bytes long")
    found = tables.store_files(spark, path).withColumn("d", F.date_format("date", "yyyy-MM-dd")).join(F.broadcast(real), "d")
    agrees = F.abs(F.col("size_mb") - F.col("bytes") / 1048576.0) <= 0.05
    return found.select("date", "files", "records", agrees.cast("long").alias("size_agrees"))


@query(
    "etag_tables",
    f"""with {V.TOLLS_SQL}, valid as (select * from tolls where data_valid = 1)
    select 'valid' as stored, etag_pair_id, vehicle_type_name, {big('sum(vehicle_count)', 'vehicle_count')},
      {num('avg(travel_time_seconds)', 'travel_time_seconds')}, {num('avg(space_mean_speed_kmh)', 'space_mean_speed_kmh')},
      {big('sum(data_valid)', 'data_valid')} from valid group by etag_pair_id, vehicle_type_name
    union all
    select 'statistics', etag_pair_id, vehicle_type_name, {big('sum(vehicle_count)', 'vehicle_count')},
      {num('avg(travel_time_seconds)', 'travel_time_seconds')}, {num('avg(space_mean_speed_kmh)', 'space_mean_speed_kmh')},
      {big('sum(data_valid)', 'data_valid')} from tolls group by etag_pair_id, vehicle_type_name""",
)
def _etag_tables(spark, sf):
    """The valid rows and the vehicle statistics as written tables, read back."""
    valid, stats = scratch_path(spark, "valid"), scratch_path(spark, "statistics")
    flows = V.tolls(spark, sf).withColumn("date", F.to_date("update_time"))
    tables.write_days(flows.where("data_valid = 1"), valid)
    summary.vehicle_stats(flows).write.parquet(stats)
    back = summary.vehicle_stats(tables.load_days(spark, valid)).withColumn("stored", F.lit("valid"))
    return back.unionByName(spark.read.parquet(stats).withColumn("stored", F.lit("statistics")))
