"""Ingest of old and repeated files, and which row of a repeated key stays."""

import datetime as dt
import os
import time

from roadweave.sources import tables
from roadweave.streaming import jobs

DOC = (
    "<L><UpdateTime>{time}</UpdateTime><VDLive><VDID>VD-N1-N-23-M-圓山</VDID>"
    "<Lane><LaneID>{lane}</LaneID><Speed>{speed}</Speed></Lane></VDLive></L>"
)


def put(folder, name, text, days_old=0):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(text)
    when = time.time() - days_old * 86400
    os.utime(path, (when, when))


def test_old_files_are_read(spark, tmp_path):
    raw, table, check = (str(tmp_path / n) for n in ("raw", "table", "check"))
    put(raw, "vd_a.xml", DOC.format(time="2025-06-25T08:00:00+08:00", lane=1, speed=80))
    jobs.ingest_vd(spark, raw, table, check)
    put(raw, "vd_b.xml", DOC.format(time="2025-06-26T08:00:00+08:00", lane=1, speed=81))
    put(raw, "vd_c.xml", DOC.format(time="2025-05-20T08:00:00+08:00", lane=1, speed=82), days_old=30)
    jobs.ingest_vd(spark, raw, table, check)
    assert sorted(r.speed for r in tables.load_days(spark, table).collect()) == [80, 81, 82]


def test_last_row_of_a_key_stays(spark, tmp_path):
    day = dt.date(2025, 6, 25)
    rows = [(day, "a", 1, 5.0, 10), (day, "a", 2, 4.0, 11), (day, "b", 1, 1.0, 1), (day, "b", 1, 2.0, 1)]
    df = spark.createDataFrame(rows, "date date, k string, seen int, v double, w int")
    table = str(tmp_path / "t")
    for _ in range(2):  # the second time nothing is new
        assert tables.append_new(df, table, ("date", "k"), latest=("seen",)) == [day]
    got = {r.k: (r.seen, r.v) for r in spark.read.parquet(table).collect()}
    assert got == {"a": (2, 4.0), "b": (1, 2.0)}
    assert spark.read.parquet(table).count() == 2


def test_scratch_is_cleared(spark, sf, tmp_path):
    from roadweave import session

    app = spark.sparkContext.applicationId
    before = session._SCRATCH.pop(app, [])
    try:
        kept = session.materialize(spark.range(5), "kept")
        session.scratch_path(spark, "never-written")
        assert kept.count() == 5 and session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    finally:
        session._SCRATCH[app] = before
