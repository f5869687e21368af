import os

import pytest

from gaugelake import schemas, settle
from gaugelake.sources import export, gauge_key, payloads, warehouse
from gaugelake.schemas import READINGS


def answers(spark, *rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], schemas.PAYLOADS)


def test_tide_answers(spark):
    many = ", ".join(f'{{"t": "2024-01-01 {h:02d}:06", "v": "{h}.5", "f": "1,0"}}' for h in range(24))
    df = answers(
        spark,
        ("1", "obs", f'{{"metadata": {{"id": "1"}}, "data": [{many}]}}'),
        ("1", "pred", '{"predictions": [{"t": "2024-01-01 00:00", "v": "1.25"}]}'),
        ("2", "obs", '{"data": [{"t": "2024-01-01 00:00", "v": ""}, {"t": "junk", "v": "x1"}, {"t": "2024-01-01 00:12", "v": 2.5}]}'),
        ("3", "obs", '{"data": []}'),
        ("4", "obs", '{"error": {"message": "No data was found."}}'),
        ("5", "obs", "no json"),
    )
    obs = payloads.tide_rows(df, "obs").collect()
    assert len(obs) == 27
    assert {(r["entity"], r["notes"]) for r in obs} == {("NOAA Observed", "observation")}
    second = sorted(((str(r["date"]), r["level"]) for r in obs if r["id"] == "2"))
    assert second == [("2024-01-01 00:00:00", None), ("2024-01-01 00:12:00", 2.5), ("None", None)]
    pred = payloads.tide_rows(df, "pred").collect()
    assert [(r["level"], r["entity"], r["notes"]) for r in pred] == [(1.25, "NOAA Predictions", "prediction")]
    assert sorted(r["id"] for r in payloads.tide_rejects(df, "obs").collect()) == ["3", "4", "5"]


def test_documents_are_parsed_once(spark):
    df = answers(spark, ("1", "obs", "{}"))
    plan = payloads.tide_rows(df, "obs")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_gauge_answers(spark):
    general = "".join(
        f"<general><data_time>2024-01-01 0{h}:00:00</data_time><data_value>{v}</data_value></general>"
        for h, v in enumerate(["1.5", "", "x"])
    )
    df = answers(spark, ("7", "obs", f"<onerain><response>{general}</response></onerain>"))
    rows = sorted(payloads.gauge_rows(df).collect(), key=lambda r: r["date"])
    assert [(r["id"], r["level"], r["entity"]) for r in rows] == [
        ("7", 1.5, "FIMAN"), ("7", None, "FIMAN"), ("7", None, "FIMAN"),
    ]


def test_gauge_key_file(spark, tmp_path):
    path = tmp_path / "key.csv"
    path.write_text(
        "﻿place,location,site_id,or_site_id,Sensor,sensor_id,or_sensor_id\n"
        '"Bay, East",Dock @ A & B,30001,11,Water Elevation,HG,5\n'
        '"Bay, East",Dock,OCAN9,,Battery,8,\n'
        ",,,,,,\n",
        encoding="utf-8",
    )
    key = gauge_key.read_gauge_key(spark, str(path))
    rows = key.orderBy("site_id").collect()
    assert [tuple(r) for r in rows] == [
        ("Bay, East", "Dock @ A & B", "30001", 11, "Water Elevation", "HG", 5),
        ("Bay, East", "Dock", "OCAN9", None, "Battery", "8", None),
    ]
    surveys = spark.createDataFrame([("S1", "30001"), ("S2", "OCAN9")], "sensor_ID STRING, wl_id STRING")
    found = gauge_key.gauge_lookup(key, surveys).collect()
    assert [tuple(r) for r in found] == [("S1", "30001", "HG")]


def test_parquet_warehouse_drops_rows_without_time(spark, frame, tmp_path):
    root = str(tmp_path / "lake")
    rows = [dict(sensor_ID="A", date="2024-01-01 00:00:00"), dict(sensor_ID="A", date=None)]
    for role, spec in warehouse.TABLES.items():
        table = frame(spec.schema, rows if role == "readings" else [])
        table.write.parquet(f"{root}/{spec.name}")
    tables = warehouse.from_parquet(spark, root)
    assert tables.readings.count() == 1
    assert tables.photos.dtypes[1] == ("DateTimeOriginalUTC", "timestamp")
    filtered = tables.readings.where("date > TIMESTAMP '2024-01-01 00:00:00'").select("sensor_ID")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(date,2024-01-01" in plan
    assert "ReadSchema: struct<sensor_ID:string,date:timestamp>" in plan


class _Reader:
    """Stands in for ``spark.read`` and notes how tables are asked for."""

    def __init__(self, frame):
        self.frame, self.asked = frame, {}

    def jdbc(self, url, table, **how):
        self.asked[table] = how
        schema = next(spec.schema for spec in warehouse.TABLES.values() if spec.name == table)
        return self.frame(schema, [])


def test_jdbc_tables_are_read_by_time_ranges(frame):
    reader = _Reader(frame)
    session = type("S", (), {"read": reader})()
    tables = warehouse.from_jdbc(
        session, "jdbc:x", "2020-01-01", "2024-01-01", tasks=12, properties={"user": "u"}
    )
    assert tables.readings.count() == 0
    assert set(reader.asked) == {spec.name for spec in warehouse.TABLES.values()}
    assert reader.asked["photo_info"] == dict(
        column="DateTimeOriginalUTC", lowerBound="2020-01-01", upperBound="2024-01-01",
        numPartitions=12, properties={"user": "u"},
    )
    assert reader.asked["camera_locations"] == dict(properties={"user": "u"})


def test_zoneless_instants_become_utc_instants(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00' AS date, 'A' AS sensor_ID")
    timed = warehouse._timed(df, warehouse.TABLES["readings"])
    assert dict(timed.dtypes)["date"] == "timestamp"
    assert str(timed.first()["date"]) == "2024-01-01 10:00:00"


def test_only_water_levels_count(frame):
    df = frame(schemas.PROVIDER, [dict(id="1", type=t) for t in ("water_level", "air_temperature", None)])
    assert warehouse.water_levels(df).count() == 1


def test_export_files(spark, frame, tmp_path):
    rows = [
        dict(sensor_ID=s, date=f"2024-01-10 {h:02d}:{m:02d}:30", sensor_elevation=-1.0, road_elevation=2.25,
             sensor_water_level_adj=h / 10 if h else None, road_water_level_adj=h / 10 - 2.25 if h else None)
        for s in ("A_1", "B_2") for h in (9, 0, 23) for m in (59, 0)
    ]
    out = str(tmp_path / "out")
    export.write_download(frame(READINGS, rows), "2024-01-10", "2024-01-12", out)
    folders = sorted(d for d in os.listdir(out) if d.startswith("file="))
    assert folders == ["file=A_1_20240110_20240112.csv", "file=B_2_20240110_20240112.csv"]
    parts = sorted(p for p in os.listdir(f"{out}/{folders[0]}") if p.endswith(".csv"))
    lines = []
    for part in parts:
        head, *body = open(f"{out}/{folders[0]}/{part}").read().splitlines()
        assert head == ",".join(export.HEADINGS.values())
        lines += body
    assert [line.split(",")[0] for line in lines] == [
        "01/10/2024 00:00", "01/10/2024 00:59", "01/10/2024 09:00",
        "01/10/2024 09:59", "01/10/2024 23:00", "01/10/2024 23:59",
    ]
    assert lines[0] == "01/10/2024 00:00,-1.0,2.25,NA,NA"
    assert lines[2] == "01/10/2024 09:00,-1.0,2.25,0.9,-1.35"


def test_settled_tables_live_in_the_shared_folder(spark):
    df = settle.settle(spark.range(3), "t")
    assert df.count() == 3
    source = df.inputFiles()[0]
    assert settle.shared_folder(spark).removeprefix("file:") in source


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class _Session:
    """Stands in for a session whose cluster names no shared folder."""

    def __init__(self, master):
        self.sparkContext = _Context(master)
        self.conf = {}


def test_no_scratch_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        settle.shared_folder(_Session("yarn"))
