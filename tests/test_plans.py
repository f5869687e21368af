"""The physical plans keep the properties the operators are designed for."""

import re

import pytest
from data import DATA
from pyspark.sql import functions as F

from gaugelake.operators import latest, overlays, segments, series, status, timeline
from gaugelake.plans.catalog import AS_OF, QUERIES
from gaugelake.schemas import READINGS
from gaugelake.sources import warehouse

FOLDER = f"{DATA}/sf0.001"
STREAMED = {name for name in QUERIES if name.startswith("q_stream_")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake(spark, frame, tmp_path_factory):
    """Readings as a Parquet table with plain columns."""
    path = str(tmp_path_factory.mktemp("lake") / "readings")
    rows = [
        dict(sensor_ID=f"S{i % 3}", place="X", date=f"2024-01-{1 + i % 28:02d} 10:00:00", sensor_water_level_adj=1.0,
             road_water_level_adj=0.0, alert_threshold=2.0, road_elevation=1.0, qa_qc_flag=False, lat=1.0, lng=1.0)
        for i in range(200)
    ]
    frame(READINGS, rows).write.parquet(path)
    return spark.read.schema(READINGS).parquet(path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for step in ("PythonUDF", "ArrowEval", "BatchEvalPython", "MapInPandas", "FlatMapGroups",
                 "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert step not in plan


def test_status_reads_five_columns_and_skips_old_row_groups(lake):
    plan = plan_of(status.flood_status(lake, AS_OF))
    wanted = {"sensor_ID", "date", "road_elevation", "alert_threshold", "sensor_water_level_adj"}
    read = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert {field.split(":")[0] for field in read[0].split(",")} == wanted
    assert "GreaterThanOrEqual(date,2024-01-" in plan
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_top_rows_are_limited_before_the_shuffle(lake, monkeypatch):
    seen = []
    settle = latest.settle

    def watched(df, label):
        seen.append(plan_of(df))
        return settle(df, label)

    monkeypatch.setattr(latest, "settle", watched)
    latest.newest_ranked(lake, ["sensor_ID"], "date", 3)
    assert "WindowGroupLimit" in seen[0] and "Partial" in seen[0]
    assert "ReadSchema: struct<sensor_ID:string,date:timestamp>" in seen[0]


def test_series_filters_reach_the_scan(lake):
    plan = plan_of(series.sensor_series(lake, "2024-01-10", "2024-01-25", ["S1"]).select("sensor_ID", "date"))
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    for part in ("GreaterThanOrEqual(date,2024-01-10 05:00:00", "LessThan(date,2024-01-25 05:00:00",
                 "Not(EqualTo(qa_qc_flag,true))", "EqualTo(sensor_ID,S1)"):
        assert part in pushed
    assert "Exchange" not in plan


def windows(plan):
    """Partition keys of the windows in a plan."""
    return [line for line in plan.splitlines() if "Window [" in line]


def test_segments_order_rows_only_inside_buckets(lake):
    drawn = lake.select("sensor_ID", "date", F.col("sensor_water_level_adj").alias("wl"))
    result = segments.gap_segments(drawn)
    result.collect()
    final = plan_of(result).split("Initial Plan")[0]
    assert "ReusedExchange" in final  # rows and bucket summary come from one shuffle
    assert final.count("FileScan parquet") == 1
    per_sensor = [w for w in windows(final) if "bucket" not in w.split("windowspecdefinition(")[1].split(" ASC")[0]]
    assert all("_w0" in w or "last" in w for w in per_sensor)  # summaries only


def test_timeline_shuffles_no_result_rows(lake):
    plan = plan_of(timeline.status_timeline(lake))
    top = plan.split("Join")[0]
    assert "Exchange" not in top


@pytest.fixture(scope="module")
def by_day(spark, lake, tmp_path_factory):
    """The same readings, and provider rows, in day folders."""
    root = str(tmp_path_factory.mktemp("days"))
    lake.withColumn("dt", F.to_date("date")).write.partitionBy("dt").parquet(f"{root}/data_for_display")
    levels = lake.selectExpr("sensor_ID AS id", "date", "1.0D AS value", "'FIMAN' AS api_name", "'water_level' AS type")
    levels.withColumn("dt", F.to_date("date")).write.partitionBy("dt").parquet(f"{root}/api_data")
    for spec in warehouse.TABLES.values():
        if spec.name not in ("data_for_display", "api_data"):
            spark.createDataFrame([], spec.schema).write.parquet(f"{root}/{spec.name}")
    return warehouse.from_parquet(spark, root, partitioned=True)


def folders_read(df):
    """Partition filters of the scans, but for those without any."""
    return [f for f in re.findall(r"PartitionFilters: \[(.*?)\]", plan_of(df)) if f]


def test_ranges_open_only_their_days(lake, by_day):
    def same(a, b):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))

    plain, days = (series.sensor_series(r, "2024-01-05", "2024-01-08") for r in (lake, by_day.readings))
    assert "dt" in folders_read(days)[0]
    same(plain, days)
    plain, days = (latest.latest_sensors(r, AS_OF, 5) for r in (lake, by_day.readings))
    assert all("dt" in f for f in folders_read(days)) and folders_read(days)
    same(plain, days)
    plain, days = (latest.newest_rows(r, ["sensor_ID"], "date") for r in (lake, by_day.readings))
    assert "dt" in folders_read(days)[0]
    same(plain, days)
    assert "dt" in folders_read(overlays.provider_observations(by_day.provider, "2024-01-05", "2024-01-08"))[0]
    plain, days = (status.flood_status(r, AS_OF) for r in (lake, by_day.readings))
    same(plain, days)


def test_a_chart_reads_each_source_once(spark):
    plan = plan_of(QUERIES["q_chart_series"](spark, FOLDER))
    assert plan.count("from_json") == 1
    scans = re.findall(r"Scan parquet.*?lineitem", plan.replace("\n", " "))
    assert plan.count("lineitem.parquet") <= 2, len(scans)
