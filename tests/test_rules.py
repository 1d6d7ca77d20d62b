import pytest
from pyspark.sql import functions as F

from roadweave.functions import rules, times


def values(spark, rows, ddl, **columns):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


ROUTE = [
    ("VD-N1-N-23-I-EN-1-圓山", True, True),
    ("VD-N1-S-25-M-LOOP-台北", True, True),
    ("VD-N1-N-27-O-SE-1-三重", True, True),
    ("VD-N1-N-22-M-LOOP", True, True),
    ("VD-N1-S-29-M-LOOP", True, True),
    ("VD-N3-N-100-M-LOOP", False, False),
    ("VD-N2-S-50-I-EN-1", False, False),
    ("VD-N1-N-35-M-LOOP", False, False),
    ("VD-N1-N-200-X", True, False),
    ("VD-N10-W-25-X", True, False),
    ("VD-N1-W-25.5-X", True, True),
    ("VD-N1-W-30-X", True, True),
    ("VD-N1-W-30.1-X", False, False),
    ("", False, False),
    (None, False, False),
]


def test_target_route(spark):
    got = values(
        spark,
        [(r[0],) for r in ROUTE],
        "id string",
        loose=rules.is_target_route(F.col("id")),
        strict=rules.is_target_route(F.col("id"), strict=True),
    )
    assert got == [(r[1], r[2]) for r in ROUTE]


def test_tolerant_int(spark):
    rows = [("51",), (" 7 ",), ("-3",), ("51.0",), ("x",), ("",), (None,)]
    got = values(spark, rows, "t string", v=rules.tolerant_int(F.col("t")))
    assert [g[0] for g in got] == [51, 7, -3, 0, 0, 0, 0]


@pytest.mark.parametrize(
    "when,label",
    [
        ("2025-06-23 07:00:00", "平日尖峰"),
        ("2025-06-23 08:59:59", "平日尖峰"),
        ("2025-06-23 09:00:00", "平日離峰"),
        ("2025-06-23 19:59:00", "平日尖峰"),
        ("2025-06-23 20:00:00", "平日離峰"),
        ("2025-06-21 09:00:00", "假日尖峰"),
        ("2025-06-21 12:00:00", "假日離峰"),
        ("2025-06-22 18:59:00", "假日尖峰"),
        (None, "平日離峰"),
    ],
)
def test_time_category(spark, when, label):
    df = spark.createDataFrame([(when,)], "t string").select(
        times.time_category(F.col("t").cast("timestamp")).alias("c")
    )
    assert df.first()["c"] == label


def test_three_peak_definitions_differ(spark):
    # Saturday 09:30: weekend peak, fused peak, no station peak
    df = spark.createDataFrame([("2025-06-21 09:30:00",)], "t string").select(
        F.col("t").cast("timestamp").alias("t")
    )
    row = df.select(
        times.time_category(F.col("t")).alias("a"),
        times.fused_calendar(F.col("t"))["is_peak_hour"].alias("b"),
        times.station_calendar(F.col("t"))["is_peak_hour"].alias("c"),
    ).first()
    assert tuple(row) == ("假日尖峰", 1, 0)


def test_speed_levels_are_right_closed(spark):
    rows = [(float(x),) for x in (0, 40, 40.1, 60, 80, 120, 120.1)]
    got = values(spark, rows, "s double", v=rules.speed_level(F.col("s")))
    assert [g[0] for g in got] == [None, 1.0, 2.0, 2.0, 3.0, 4.0, None]


def test_vehicle_and_flow_rules(spark):
    rows = [("31", 207, 3), ("5", 0, 4), ("77", 90, 0)]
    got = values(
        spark,
        rows,
        "code string, t int, n int",
        name=rules.vehicle_name(F.col("code")),
        minutes=rules.travel_minutes(F.col("t")),
        ok=rules.flow_is_valid(F.col("t"), F.col("n")),
    )
    assert got == [("小客車", 3.45, 1), ("聯結車", 0.0, 0), ("未知(77)", 1.5, 0)]


def test_bands_and_midpoint(spark):
    got = values(
        spark,
        [(85.0, 0.9, "85-92%"), (49.9, 0.6, "n/a"), (50.0, 0.2, None)],
        "s double, r double, t string",
        status=rules.traffic_status(F.col("s")),
        band=rules.r2_band(F.col("r")),
        mid=rules.accuracy_midpoint(F.col("t")),
    )
    assert got == [
        ("暢通🟢", "excellent", 88.5),
        ("擁堵🔴", "acceptable", 75.0),
        ("緩慢🟡", "insufficient", 75.0),
    ]


def test_file_names(spark):
    rows = [("20250621_101500_VD_live.xml",), ("plain.xml",), ("a_b",), ("靜態.txt",)]
    got = values(
        spark,
        rows,
        "n string",
        original=rules.original_name(F.col("n")),
        vd=rules.is_vd_file(F.col("n")),
    )
    assert got == [
        ("VD_live.xml", True),
        ("plain.xml", False),
        ("a_b", False),
        ("靜態.txt", True),
    ]
