import gzip

from pyspark.sql import functions as F

from roadweave.plans import pipeline
from roadweave.sources import documents, tables

NS = "http://traffic.transportdata.tw/standard/traffic/schema/"

VD = f"""<?xml version="1.0" encoding="UTF-8"?>
<VDLiveList xmlns="{NS}">
  <UpdateTime>2025-06-23T08:15:00+08:00</UpdateTime>
  <VDLives>
    <VDLive><VDID>VD-N1-N-23-I-EN-1-圓山</VDID>
      <LinkFlows><LinkFlow><LinkID>1</LinkID><Lanes>
        <Lane><LaneID>0</LaneID><LaneType>1</LaneType><Speed>88</Speed><Occupancy>7</Occupancy>
          <Vehicles>
            <Vehicle><VehicleType>S</VehicleType><Volume>9</Volume><Speed>90</Speed></Vehicle>
            <Vehicle><VehicleType>L</VehicleType><Volume>2</Volume><Speed>80</Speed></Vehicle>
            <Vehicle><VehicleType>S</VehicleType><Volume>5</Volume><Speed>91</Speed></Vehicle>
            <Vehicle><Volume>50</Volume></Vehicle>
          </Vehicles></Lane>
        <Lane><LaneID>1</LaneID><Speed>fast</Speed><Occupancy>51.0</Occupancy></Lane>
      </Lanes></LinkFlow></LinkFlows></VDLive>
    <VDLive><VDID>VD-N3-N-100-M-LOOP</VDID><Lane><LaneID>0</LaneID></Lane></VDLive>
    <VDLive><Lane><LaneID>9</LaneID></Lane></VDLive>
    <VDLive><VDID>VD-N1-S-25-M-台北</VDID><Lane><LaneID>0</LaneID><Speed>60</Speed></Lane></VDLive>
  </VDLives>
</VDLiveList>"""

PREFIXED = f"""<t:Root xmlns:t="{NS}"><t:UpdateTime>not a time</t:UpdateTime>
  <t:VDLive><t:VDID>VD-N1-N-27-三重</t:VDID><t:Lane><t:LaneID>3</t:LaneID><t:Speed>40</t:Speed></t:Lane></t:VDLive>
</t:Root>"""


def etag_xml(ns=f' xmlns="{NS}"', time="2025-06-25T16:20:00+08:00"):
    return f"""<?xml version="1.0" encoding="UTF-8"?>
<ETagPairLiveList{ns}><UpdateTime>{time}</UpdateTime><UpdateInterval>300</UpdateInterval>
 <ETagPairLives>
  <ETagPairLive><ETagPairId>01F0017N-01F0005N</ETagPairId><Flows>
    <Flow><VehicleType>31</VehicleType><TravelTime>68</TravelTime><StandardDeviation>8.5</StandardDeviation>
      <SpaceMeanSpeed>95.3</SpaceMeanSpeed><VehicleCount>25</VehicleCount></Flow>
    <Flow><VehicleType>32</VehicleType><TravelTime>0</TravelTime><VehicleCount>0</VehicleCount></Flow>
    <Flow><VehicleType>41</VehicleType><TravelTime>12.5</TravelTime><VehicleCount>1</VehicleCount></Flow>
  </Flows></ETagPairLive>
  <ETagPairLive><ETagPairId>01F9999N-01F8888N</ETagPairId><Flows>
    <Flow><VehicleType>31</VehicleType><TravelTime>68</TravelTime></Flow></Flows></ETagPairLive>
  <ETagPairLive><ETagPairId> 01F0029N-01F0017N </ETagPairId><Flows>
    <Flow><TravelTime>120</TravelTime><SpaceMeanSpeed>60</SpaceMeanSpeed><VehicleCount>3</VehicleCount></Flow>
  </Flows></ETagPairLive>
 </ETagPairLives></ETagPairLiveList>"""


def put(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    if zipped:
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(text)
    else:
        path.write_text(text, encoding="utf-8")


def test_vd_files(spark, tmp_path):
    put(tmp_path / "a" / "VD_0815.xml", VD)
    put(tmp_path / "b" / "traffic_x.txt", PREFIXED)
    put(tmp_path / "b" / "vd_bad.xml", "<invalid>xml content")
    put(tmp_path / "b" / "weather.xml", VD)
    put(tmp_path / "b" / "vd.csv", VD)
    docs = documents.vd_documents(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in docs.select("file_name").collect()) == [
        "VD_0815.xml",
        "traffic_x.txt",
        "vd_bad.xml",
    ]
    rows = {(r["vd_id"], r["lane_id"]): r for r in documents.parse_vd(docs).collect()}
    assert set(rows) == {
        ("VD-N1-N-23-I-EN-1-圓山", 0),
        ("VD-N1-N-23-I-EN-1-圓山", 1),
        ("VD-N1-S-25-M-台北", 0),
        ("VD-N1-N-27-三重", 3),
    }
    first = rows["VD-N1-N-23-I-EN-1-圓山", 0]
    assert str(first["update_time"]) == "2025-06-23 08:15:00"
    assert (first["volume_small"], first["speed_small"]) == (5, 91)
    assert (first["volume_large"], first["volume_truck"], first["volume_total"]) == (2, 0, 7)
    second = rows["VD-N1-N-23-I-EN-1-圓山", 1]
    assert (second["speed"], second["occupancy"], second["lane_type"]) == (0, 0, 0)
    assert first["time_is_fallback"] == 0
    assert rows["VD-N1-N-27-三重", 3]["time_is_fallback"] == 1


def test_vd_columns(spark, tmp_path):
    put(tmp_path / "VD_0815.xml", VD)
    out = documents.parse_vd(documents.vd_documents(spark, str(tmp_path)))
    assert out.columns[1:15] == (
        "date update_time vd_id lane_id lane_type speed occupancy volume_total volume_small"
        " volume_large volume_truck speed_small speed_large speed_truck"
    ).split()


def test_etag_files(spark, tmp_path):
    day = tmp_path / "ETag_Data_20250625"
    put(day / "ETagPairLive_1620.xml.gz", etag_xml(), True)
    put(day / "ETagPairLive_1625.xml.gz", etag_xml(ns=""), True)
    put(day / "ETagPairLive_9999.xml.gz", etag_xml(), True)
    put(day / "ETagPairLive_bad.xml.gz", "<invalid>xml content", True)
    put(day / "ETagPairLive_x.xml.gz", etag_xml(time="2025-01-01T09:05:30Z"), True)
    put(day / "ETagPairLive_y.xml.gz", etag_xml(time="whenever"), True)
    put(tmp_path / "ETag_Data_2025062" / "ETagPairLive_1620.xml.gz", etag_xml(), True)
    put(tmp_path / "ETag_Data_20259999" / "ETagPairLive_1620.xml.gz", etag_xml(), True)
    put(tmp_path / "Invalid_Folder" / "ETagPairLive_1620.xml.gz", etag_xml(), True)
    out = documents.parse_etag(documents.etag_documents(spark, str(tmp_path)))
    times = {str(r["update_time"]) for r in out.select("update_time").distinct().collect()}
    assert times == {
        "2025-06-25 16:20:00",
        "2025-06-25 16:25:00",
        "2025-06-25 09:05:30",
        "2025-06-25 12:00:00",
    }
    one = (
        out.where(F.col("update_time") == F.lit("2025-06-25 16:20:00").cast("timestamp"))
        .orderBy("flow_pos")
        .collect()
    )
    assert [(r["etag_pair_id"], r["vehicle_type_code"], r["data_valid"]) for r in one] == [
        ("01F0017N-01F0005N", "31", 1),
        ("01F0017N-01F0005N", "32", 0),
        ("01F0029N-01F0017N", "31", 1),
    ]
    assert one[0]["travel_time_minutes"] == 1.13
    assert (one[0]["segment_name"], one[0]["direction"], one[0]["distance_km"]) == ("台北→圓山", "N", 1.8)
    assert (one[1]["space_mean_speed_kmh"], one[1]["travel_time_minutes"]) == (0.0, 0.0)


def test_many_pairs_in_one_file(spark, tmp_path):
    flows = "".join(
        f"<ETagPairLive><ETagPairId>01F{i:04d}N-01F0005N</ETagPairId><Flows><Flow><TravelTime>60</TravelTime>"
        f"<VehicleCount>1</VehicleCount></Flow></Flows></ETagPairLive>"
        for i in range(50)
    )
    text = f"<ETagPairLiveList><ETagPairLives>{flows}</ETagPairLives></ETagPairLiveList>"
    put(tmp_path / "ETag_Data_20250621" / "ETagPairLive_0000.xml.gz", text, True)
    docs = documents.etag_documents(spark, str(tmp_path))
    assert documents.parse_etag(docs).count() == 1
    assert documents.parse_etag(docs, targets_only=False).count() == 50


def test_ingest_is_incremental_and_archives(spark, tmp_path):
    store = pipeline.Store(str(tmp_path / "data"))
    raw = tmp_path / "data" / "raw" / "vd"
    put(raw / "VD_0815.xml", VD)
    assert pipeline.check_system_readiness(spark, store).first()["next_action"] == "process_raw_files"
    assert pipeline.process_target_route_data(spark, store).count() == 3
    assert pipeline.check_system_readiness(spark, store).first()["next_action"] == "proceed_to_analysis"
    # the same rows under another name are not stored twice; a known name is skipped
    put(raw / "again" / "VD_copy.xml", VD)
    put(raw / "other" / "VD_0815.xml", VD.replace("08:15:00", "09:15:00"))
    put(raw / "VD_0816.xml", VD.replace("08:15:00", "08:16:00"))
    lanes = pipeline.process_target_route_data(spark, store)
    assert lanes.count() == 6
    put(raw / "VD_0817.xml", VD.replace("08:15:00", "08:17:00"))
    assert pipeline.process_target_route_data(spark, store).count() == 9
    archived = list((tmp_path / "data" / "archive").rglob("VD_0815.xml"))
    assert archived
    peaks = lanes.where(F.col("time_category").contains("尖峰")).count()
    assert peaks == 6
    assert pipeline.load_target_route_data(spark, store, "2025-06-23").count() == 9
    assert pipeline.load_target_route_data(spark, store, "2020-01-01").count() == 0


def test_etag_ingest_keeps_equal_names_of_other_days(spark, tmp_path):
    store = pipeline.Store(str(tmp_path / "data"))
    raw = tmp_path / "data" / "raw" / "etag"
    put(raw / "ETag_Data_20250625" / "ETagPairLive_1620.xml.gz", etag_xml(), True)
    put(raw / "ETag_Data_20250626" / "ETagPairLive_1620.xml.gz", etag_xml(), True)
    assert pipeline.process_etag_data(spark, store).count() == 6
    days = pipeline.get_etag_summary(spark, store).orderBy("date").collect()
    assert [(r["total_records"], r["valid_records"], r["unique_pairs"]) for r in days] == [(3, 2, 2)] * 2
    assert days[0]["vehicle_type_distribution"] == {"小客車": 2, "小貨車": 1}


def test_pending_files(spark):
    docs = spark.createDataFrame([("vd_1.xml",), ("vd_2.xml",)], "file_name string")
    ledger = spark.createDataFrame([("20250101_000000_vd_1.xml",)], "archived_name string")
    assert [r["file_name"] for r in documents.pending_files(docs, ledger).collect()] == ["vd_2.xml"]


def test_file_schemas_and_drift(spark, tmp_path):
    for i, cols in enumerate((["a", "b"], ["a", "b"], ["a", "c", "d"])):
        df = spark.range(1).select(*[F.lit(1).alias(c) for c in cols])
        df.coalesce(1).write.parquet(str(tmp_path / f"day{i}"))
    files = tables.file_schemas(spark, str(tmp_path))
    out = tables.flag_schema_drift(files).collect()
    assert len(out) == 3
    odd = next(r for r in out if r["column_count"] == 3)
    assert (odd["modal_count"], odd["extra_columns"], odd["missing_columns"]) == (2, ["c", "d"], ["b"])
    hist = {r["column_count"]: r["files"] for r in tables.column_histogram(files).collect()}
    assert hist == {2: 2, 3: 1}


def test_empty_store(spark, tmp_path):
    store = pipeline.Store(str(tmp_path / "nothing"))
    assert pipeline.check_system_readiness(spark, store).first()["next_action"] == "add_raw_files"
    assert pipeline.process_target_route_data(spark, store).count() == 0
    assert pipeline.load_target_route_data(spark, store, "2025-06-23").count() == 0
    assert pipeline.auto_process_data(spark, store).first()["overall_readiness"] == "no_data"


def test_each_document_is_parsed_once(spark, tmp_path):
    put(tmp_path / "VD_0815.xml", VD)
    put(tmp_path / "ETag_Data_20250625" / "ETagPairLive_1620.xml.gz", etag_xml(), True)
    for df in (
        documents.parse_vd(documents.vd_documents(spark, str(tmp_path))),
        documents.parse_etag(documents.etag_documents(spark, str(tmp_path))),
    ):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
