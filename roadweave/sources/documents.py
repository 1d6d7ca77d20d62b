"""XML feed files as text documents, and their parsing into typed rows.

A snapshot file is small (one minute or five minutes of the network) and its root
carries the time next to its children, so a file is one document. Parsing is
``from_xml`` in the JVM; a document that is not well-formed yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave import constants as C
from roadweave.functions import rules
from roadweave.operators.summary import with_pair_info

_LANE = (
    "struct<LaneID:string,LaneType:string,Speed:string,Occupancy:string,"
    "Vehicles:struct<Vehicle:array<struct<VehicleType:string,Volume:string,Speed:string>>>>"
)
_VDLIVE = (
    f"struct<VDID:string,Lane:array<{_LANE}>,Lanes:struct<Lane:array<{_LANE}>>,"
    f"LinkFlows:struct<LinkFlow:array<struct<Lane:array<{_LANE}>,Lanes:struct<Lane:array<{_LANE}>>>>>>"
)
VD_SCHEMA = (
    f"UpdateTime string, VDLive array<{_VDLIVE}>, VDLives struct<VDLive:array<{_VDLIVE}>>"
)
_FLOW = (
    "struct<VehicleType:string,TravelTime:string,StandardDeviation:string,"
    "SpaceMeanSpeed:string,VehicleCount:string>"
)
_PAIR = f"struct<ETagPairId:string,Flows:struct<Flow:array<{_FLOW}>>>"
ETAG_SCHEMA = (
    f"UpdateTime string, ETagPairLive array<{_PAIR}>, ETagPairLives struct<ETagPairLive:array<{_PAIR}>>"
)
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


#: Spark's file stream leaves out files a week older than the newest one, unless told otherwise.
ANY_AGE = "36500d"


def read_documents(
    spark: SparkSession,
    path: str,
    glob: str,
    streaming: bool = False,
    max_files: int | None = None,
    archive_dir: str | None = None,
    by_name_only: bool = False,
) -> DataFrame:
    """Files below ``path`` as (content, file_name, file_path, modified).

    As a stream, files already seen are skipped by full path, or by bare name
    with ``by_name_only``; ``archive_dir`` moves a file there once its batch is
    committed. A file is read however old it is: back-filled days come late.
    """
    reader = spark.readStream if streaming else spark.read
    reader = (
        reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    )
    if streaming:
        reader = reader.option("maxFileAge", ANY_AGE)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        if by_name_only:
            reader = reader.option("fileNameOnly", "true")
        if archive_dir:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
        raw = reader.format("text").option("wholetext", "true").load(path)
    else:
        raw = reader.text(path, wholetext=True)
    return raw.select(
        F.col("value").alias("content"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def vd_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """Detector files: ``*.xml`` and ``*.txt`` at any depth whose name says so."""
    docs = read_documents(spark, path, "*.{xml,txt}", **options)
    return docs.where(rules.is_vd_file(F.col("file_name")))


def etag_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """Gantry files ``ETag_Data_YYYYMMDD/ETagPairLive_*.xml.gz`` with their folder date."""
    docs = read_documents(spark, path, "ETagPairLive_*.xml.gz", **options)
    return with_folder_date(docs)


def with_folder_date(docs: DataFrame) -> DataFrame:
    folder = F.regexp_extract("file_path", r"/ETag_Data_(\d{8})/[^/]+$", 1)
    return docs.withColumn("folder_date", F.try_to_date(folder, "yyyyMMdd")).where(
        F.col("folder_date").isNotNull()
    )


def pending_files(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose name the ledger of archived names does not hold."""
    done = ledger.select(rules.original_name(F.col("archived_name")).alias("file_name")).distinct()
    return docs.join(done, "file_name", "left_anti")


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _xml_time(text: Column) -> Column:
    plain = F.replace(text, F.lit("+08:00"), F.lit(""))
    return F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def parse_vd(docs: DataFrame, strict: bool = False, route_only: bool = True) -> DataFrame:
    """Documents to one row per lane of the target route.

    Bad or absent numbers are 0; of repeated vehicle types the last counts. Where
    the document's time is missing or unreadable the file's modification time is
    used and ``time_is_fallback`` is 1.
    """
    root = F.from_xml("content", VD_SCHEMA, _OPTIONS)
    parsed = docs.select("file_name", "modified", root.alias("r"))
    stated = _xml_time(F.col("r.UpdateTime"))
    lives = F.concat(
        F.coalesce("r.VDLive", _empty(_VDLIVE)), F.coalesce("r.VDLives.VDLive", _empty(_VDLIVE))
    )
    per_vd = parsed.select(
        "file_name",
        F.coalesce(stated, "modified").alias("update_time"),
        stated.isNull().cast("int").alias("time_is_fallback"),
        # outer: a filter inferred for an inner explode would parse each document again
        F.explode_outer(lives).alias("vd"),
    ).where(F.col("vd.VDID").isNotNull())
    if route_only:
        per_vd = per_vd.where(rules.is_target_route(F.col("vd.VDID"), strict))
    none = _empty(_LANE)

    def link_lanes(link: Column) -> Column:
        return F.concat(F.coalesce(link["Lane"], none), F.coalesce(link["Lanes"]["Lane"], none))

    lanes = F.concat(
        F.coalesce("vd.Lane", none),
        F.coalesce("vd.Lanes.Lane", none),
        F.coalesce(F.flatten(F.transform("vd.LinkFlows.LinkFlow", link_lanes)), none),
    )
    per_lane = per_vd.select(
        "file_name",
        "update_time",
        "time_is_fallback",
        F.col("vd.VDID").alias("vd_id"),
        F.explode(lanes).alias("lane"),
    )
    return per_lane.select("file_name", *lane_columns(), "time_is_fallback")


def last_vehicle(vehicles: Column, kind: str) -> Column:
    """The last entry of a vehicle type, or null."""
    return F.try_element_at(F.filter(vehicles, lambda v: v["VehicleType"] == kind), F.lit(-1))


def vehicle_columns(vehicles: Column) -> dict[str, Column]:
    """``volume_*`` and ``speed_*`` of the three classes and the total volume."""
    kinds = {"small": "S", "large": "L", "truck": "T"}
    out = {}
    for name, code in kinds.items():
        entry = last_vehicle(vehicles, code)
        out[f"volume_{name}"] = rules.tolerant_int(entry["Volume"])
        out[f"speed_{name}"] = rules.tolerant_int(entry["Speed"])
    total = out["volume_small"] + out["volume_large"] + out["volume_truck"]
    return {"volume_total": total, **out}


def lane_columns() -> list[Column]:
    v = vehicle_columns(F.col("lane.Vehicles.Vehicle"))
    order = ("volume_total", "volume_small", "volume_large", "volume_truck")
    speeds = ("speed_small", "speed_large", "speed_truck")
    return [
        F.to_date("update_time").alias("date"),
        F.col("update_time"),
        F.col("vd_id"),
        rules.tolerant_int(F.col("lane.LaneID")).alias("lane_id"),
        rules.tolerant_int(F.col("lane.LaneType")).alias("lane_type"),
        rules.tolerant_int(F.col("lane.Speed")).alias("speed"),
        rules.tolerant_int(F.col("lane.Occupancy")).alias("occupancy"),
        *[v[c].alias(c) for c in order],
        *[v[c].alias(c) for c in speeds],
    ]


def _named_digits(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"^ETagPairLive_(?:.*_)?(\d{4})\.xml\.gz$", 1)


def _named_time(folder_date: Column, file_name: Column) -> Column:
    digits = _named_digits(file_name)
    hour = F.substring(digits, 1, 2).try_cast("int")
    minute = F.substring(digits, 3, 2).try_cast("int")
    y, m, d = F.year(folder_date), F.month(folder_date), F.day(folder_date)
    return F.try_make_timestamp(y, m, d, hour, minute, F.lit(0))


def named_time_is_possible(folder_date: Column, file_name: Column) -> Column:
    """False for a name whose four digits are no time of day; such a file is skipped."""
    return (_named_digits(file_name) == "") | _named_time(folder_date, file_name).isNotNull()


def gantry_time(folder_date: Column, file_name: Column, xml_time: Column) -> Column:
    """Time on the folder's date: from ``_HHMM`` of the name, else from the document,
    else noon."""
    y, m, d = F.year(folder_date), F.month(folder_date), F.day(folder_date)
    t = _xml_time(F.replace(xml_time, F.lit("Z"), F.lit("")))
    from_xml = F.try_make_timestamp(y, m, d, F.hour(t), F.minute(t), F.second(t))
    noon = F.try_make_timestamp(y, m, d, F.lit(12), F.lit(0), F.lit(0))
    return F.coalesce(_named_time(folder_date, file_name), from_xml, noon)


def _or_default(text: Column, default: str) -> Column:
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(F.trim(text))




def parse_etag(docs: DataFrame, targets_only: bool = True) -> DataFrame:
    """Documents (with ``folder_date``) to one row per flow of the target pairs.

    Absent fields take their default; a flow with unreadable numbers is dropped.
    ``flow_pos`` is the flow's place in its document.
    """
    root = F.from_xml("content", ETAG_SCHEMA, _OPTIONS)
    readable = docs.where(named_time_is_possible(F.col("folder_date"), F.col("file_name")))
    parsed = readable.select("folder_date", "file_name", root.alias("r"))
    when = gantry_time(F.col("folder_date"), F.col("file_name"), F.col("r.UpdateTime"))
    pairs = F.concat(
        F.coalesce("r.ETagPairLive", _empty(_PAIR)),
        F.coalesce("r.ETagPairLives.ETagPairLive", _empty(_PAIR)),
    )
    per_pair = parsed.select(
        when.alias("update_time"), F.posexplode_outer(pairs).alias("pair_pos", "pair")
    )
    per_flow = per_pair.select(
        "update_time",
        F.trim("pair.ETagPairId").alias("etag_pair_id"),
        "pair_pos",
        F.posexplode("pair.Flows.Flow").alias("pos", "flow"),
    ).where(F.col("etag_pair_id") != "")
    raw = per_flow.select(
        "update_time",
        "etag_pair_id",
        _or_default(F.col("flow.VehicleType"), C.DEFAULT_VEHICLE).alias("vehicle_type_code"),
        _or_default(F.col("flow.TravelTime"), "0").try_cast("int").alias("travel_time_seconds"),
        _or_default(F.col("flow.VehicleCount"), "0").try_cast("int").alias("vehicle_count"),
        _or_default(F.col("flow.SpaceMeanSpeed"), "0").try_cast("double").alias("speed_raw"),
        _or_default(F.col("flow.StandardDeviation"), "0").try_cast("double").alias("sd_raw"),
        (F.col("pair_pos") * 1_000_000 + F.col("pos")).cast("long").alias("flow_pos"),
    ).where(
        F.col("travel_time_seconds").isNotNull()
        & F.col("vehicle_count").isNotNull()
        & F.col("speed_raw").isNotNull()
        & F.col("sd_raw").isNotNull()
    )
    typed = raw.withColumns(
        {
            "space_mean_speed_kmh": F.when(~F.isnan("speed_raw"), F.col("speed_raw")),
            "standard_deviation": F.when(~F.isnan("sd_raw"), F.col("sd_raw")),
        }
    ).drop("speed_raw", "sd_raw")
    return describe_flows(typed, targets_only)


def describe_flows(flows: DataFrame, targets_only: bool = True) -> DataFrame:
    """Add vehicle name, minutes, validity and the pair's attributes."""
    named = flows.withColumns(
        {
            "vehicle_type_name": rules.vehicle_name(F.col("vehicle_type_code")),
            "travel_time_minutes": rules.travel_minutes(F.col("travel_time_seconds")),
            "data_valid": rules.flow_is_valid(F.col("travel_time_seconds"), F.col("vehicle_count")),
        }
    )
    full = with_pair_info(named, targets_only)
    return full.select(
        F.to_date("update_time").alias("date"),
        "update_time",
        "etag_pair_id",
        "vehicle_type_code",
        "vehicle_type_name",
        "travel_time_seconds",
        "travel_time_minutes",
        "vehicle_count",
        "space_mean_speed_kmh",
        "standard_deviation",
        "segment_name",
        "direction",
        "distance_km",
        "data_valid",
        "flow_pos",
    )
