import pytest
from pyspark.sql import functions as F

from gaugelake.operators import series
from gaugelake.schemas import READINGS

CONSTANTS = "sensor_ID STRING, sensor_elevation DOUBLE, road_elevation DOUBLE"
REFS = "sensor_ID STRING, reference_elevation DOUBLE, reference_elevation_type STRING"


def reading(date, level=0.0, sensor="A", road=2.0, flag=False, **more):
    return dict(
        sensor_ID=sensor, date=date, sensor_water_level_adj=level, qa_qc_flag=flag,
        road_water_level_adj=None if level is None else level - road, **more,
    )


@pytest.mark.parametrize(
    "start, end, first, last",
    [
        ("2024-01-10", "2024-01-11", "2024-01-10 05:00:00", "2024-01-11 05:00:00"),
        ("2024-07-10", "2024-07-11", "2024-07-10 04:00:00", "2024-07-11 04:00:00"),
        ("2024-03-10", "2024-03-11", "2024-03-10 05:00:00", "2024-03-11 04:00:00"),
    ],
)
def test_range_is_half_open_on_local_days(frame, start, end, first, last):
    df = frame(READINGS, [reading(first), reading(last)])
    got = series.sensor_series(df, start, end).collect()
    assert [str(r["date"]) for r in got] == [first]


def test_quality_filter_drops_missing_flags(frame):
    day = "2024-01-10 12:00:00"
    df = frame(READINGS, [reading(day, 1.0, flag=f) for f in (False, True, None)])
    assert series.sensor_series(df, "2024-01-10", "2024-01-11").count() == 1


def test_sensor_choice_by_list_and_by_table(spark, frame):
    day = "2024-01-10 12:00:00"
    df = frame(READINGS, [reading(day, sensor=s) for s in "ABC"])
    ids = spark.createDataFrame([("A",), ("C",), ("C",)], "sensor_ID STRING")
    for choice in (["A", "C"], ids):
        got = series.sensor_series(df, "2024-01-10", "2024-01-11", choice).collect()
        assert sorted(r["sensor_ID"] for r in got) == ["A", "C"]


def test_default_range(spark):
    first, last = series.default_range("2024-03-01 10:00:00")
    row = spark.range(1).select(first.alias("a"), last.alias("b")).first()
    assert (str(row["a"]), str(row["b"])) == ("2024-02-28", "2024-03-02")


@pytest.mark.parametrize(
    "days, admin, allowed, overlay",
    [(30, False, True, True), (31, False, True, False), (32, False, False, False), (32, True, True, False),
     (-30, False, True, True), (-31, False, True, False)],
)
def test_request_guard(spark, days, admin, allowed, overlay):
    df = spark.sql(
        f"SELECT 1 AS request_id, DATE'2024-03-01' AS first_day, DATE_ADD(DATE'2024-03-01', {days}) AS last_day,"
        f" {str(admin).lower()} AS admin"
    )
    row = series.request_guard(df).first()
    assert (row["days"], row["allowed"], row["overlay_allowed"]) == (days, allowed, overlay)


def test_dry_readings_are_blanked_strictly_inside_the_band(frame):
    sixth = 1 / 6
    levels = [0.0, 0.16, -0.16, 0.17, -0.17, sixth, -sixth, None]
    df = frame(READINGS, [reading(f"2024-01-10 12:00:{i:02d}", v) for i, v in enumerate(levels)])
    constants = frame(CONSTANTS, [dict(sensor_ID="A", sensor_elevation=0.0, road_elevation=2.0)])
    got = series.blank_dry(df, constants, series.NAVD88).orderBy("date").collect()
    assert [r["wl"] for r in got] == [None, None, None, 0.17, -0.17, sixth, -sixth, None]
    both = series.blank_dry(df, constants)
    assert {r["datum"] for r in both.collect()} == {"Road", "NAVD88"}
    assert both.where("datum = 'Road' AND wl IS NULL").count() >= 4


def test_unknown_elevation_blanks_nothing(frame):
    df = frame(READINGS, [reading("2024-01-10 12:00:00", 0.0)])
    for constants in ([], [dict(sensor_ID="A")]):
        got = series.blank_dry(df, frame(CONSTANTS, constants), series.NAVD88).collect()
        assert [r["wl"] for r in got] == [0.0]


def bounds(frame, readings, reference=None, road=2.0, overlay=False):
    constants = frame(CONSTANTS, [dict(sensor_ID="A", sensor_elevation=-1.0, road_elevation=road)])
    refs = frame(REFS, [dict(sensor_ID="A", reference_elevation=reference)])
    got = series.axis_bounds(frame(READINGS, readings), constants, refs, overlay).collect()
    return {r["datum"]: (r["y_min"], r["y_max"]) for r in got}


def test_axis_bounds_follow_the_data_when_it_passes_the_lines(frame):
    day = "2024-01-10 12:00:00"
    rows = [reading(day, 3.0), reading(day, -2.5)]
    assert bounds(frame, rows, reference=0.0) == {"NAVD88": (-2.5, 3.0), "Road": (-2.5, 1.0)}


def test_axis_bounds_follow_the_lines_otherwise(frame):
    rows = [reading("2024-01-10 12:00:00", 1.0)]
    got = bounds(frame, rows, reference=0.5)
    # The lower bound compares the absolute level in both datums.
    assert got == {"NAVD88": (0.25, 2.25), "Road": (-1.75, 0.25)}


def test_axis_bounds_special_cases(frame):
    rows = [reading("2024-01-10 12:00:00", 1.0)]
    assert bounds(frame, rows) == {"NAVD88": (-2.0, 2.25), "Road": (-4.0, 0.25)}
    assert bounds(frame, [], reference=0.5) == {"NAVD88": (None, None), "Road": (None, None)}
    assert bounds(frame, []) == {"NAVD88": (-2.0, None), "Road": (-4.0, None)}
    assert bounds(frame, rows, reference=0.5, overlay=True)["Road"] == (None, 0.25)
    missing = [reading("2024-01-10 12:00:00", None)]
    assert bounds(frame, missing, reference=0.5) == {"NAVD88": (0.25, 2.25), "Road": (-1.75, 0.25)}


def test_reference_lines(frame):
    constants = frame(CONSTANTS, [dict(sensor_ID=s, sensor_elevation=-1.0, road_elevation=2.0) for s in "ABC"])
    refs = frame(
        REFS,
        [dict(sensor_ID="A", reference_elevation=0.5, reference_elevation_type="drain_bottom"),
         dict(sensor_ID="B", reference_elevation=0.5, reference_elevation_type="land")],
    )
    rows = {(r["sensor_ID"], r["datum"]): r for r in series.reference_lines(constants, refs, "1970-01-01 00:00:01").collect()}
    a = rows["A", "Road"]
    assert (a["road"], a["sensor"], a["reference"], a["reference_label"]) == (0.0, -3.0, -1.5, "Bottom of Drain")
    assert rows["B", "NAVD88"]["reference_label"] == "Land Elevation"
    assert rows["C", "NAVD88"]["reference_label"] is None
    assert a["now_ms"] == 1000


def test_no_data_notice(frame):
    sensors = frame(CONSTANTS, [dict(sensor_ID=s) for s in ("A", "B", "CB_1")])
    drawn = frame(READINGS, [reading("2024-01-10 12:00:00")])
    got = series.no_data(sensors, drawn, F.col("sensor_ID").contains("CB_"))
    assert {r["sensor_ID"]: (r["n"], r["no_data"]) for r in got.collect()} == {
        "A": (1, False), "B": (0, True), "CB_1": (0, False),
    }


def test_chart_series_for_administrators(frame):
    df = frame(READINGS, [reading("1970-01-01 00:00:01", 5.0, sensor_water_level=5.5, road_water_level=3.5, voltage=4.0)])
    constants = frame(CONSTANTS, [dict(sensor_ID="A", sensor_elevation=0.0, road_elevation=2.0)])
    overlay = frame(
        "sensor_ID STRING, date TIMESTAMP, road_water_level DOUBLE, sensor_water_level DOUBLE, entity STRING",
        [dict(sensor_ID="A", date="1970-01-01 00:00:02", road_water_level=1.0, sensor_water_level=3.0, entity="X")],
    )
    plain = series.chart_series(df, constants, [overlay])
    assert sorted(tuple(r) for r in plain.collect()) == [
        ("A", "NAVD88", "Water Level", 1000, 5.0), ("A", "NAVD88", "X", 2000, 3.0),
        ("A", "Road", "Water Level", 1000, 3.0), ("A", "Road", "X", 2000, 1.0),
    ]
    full = series.chart_series(df, constants, [overlay], admin=True)
    extra = sorted(tuple(r)[1:] for r in full.exceptAll(plain).collect())
    assert extra == [
        ("NAVD88", "Battery (Voltage/10)", 1000, 0.4), ("NAVD88", "Water Level (unadjusted)", 1000, 5.5),
        ("Road", "Battery (Voltage/10)", 1000, 0.4), ("Road", "Water Level (unadjusted)", 1000, 3.5),
    ]


def test_chart_bounds(spark):
    lo, hi = series.chart_bounds("1970-01-01", "1970-01-02")
    row = spark.range(1).select(lo.alias("a"), hi.alias("b")).first()
    assert (row["a"], row["b"]) == (5 * 3600_000, 29 * 3600_000)
