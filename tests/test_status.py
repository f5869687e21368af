import random

import pytest
from pyspark.sql import functions as F

from gaugelake.operators import latest, status, timeline
from gaugelake.schemas import READINGS

NOW = "2024-01-30 12:00:00"
AGES = {"current": "2024-01-30 11:50:00", "silent": "2024-01-30 11:00:00", "down": "2024-01-30 08:00:00"}


# (above alert, above road): status while current, status while silent.
TRUTH = {
    (True, True): ("FLOODING", "FLOODING"),
    (True, False): ("WARNING", "FLOODING"),
    (True, None): (None, None),
    (False, True): ("FLOODING", "UNKNOWN"),
    (False, False): ("NOT FLOODING", "UNKNOWN"),
    (False, None): (None, "UNKNOWN"),
    (None, True): (None, None),
    (None, False): (None, None),
    (None, None): (None, None),
}


def test_truth_table_with_missing_facts(spark):
    facts = [(a, r, c, d) for a, r in TRUTH for c in (True, False) for d in (True, False)]
    df = spark.createDataFrame(facts, "a BOOLEAN, r BOOLEAN, c BOOLEAN, d BOOLEAN")
    got = df.withColumn("s", status.status_of(*(F.col(x) for x in "arcd"))).collect()
    assert len(got) == 36
    for row in got:
        current, silent = TRUTH[row["a"], row["r"]]
        expected = "UNKNOWN" if row["d"] else current if row["c"] else silent
        assert row["s"] == expected, row


def sensor(name, date, level, alert=1.0, road=2.0, **more):
    return dict(
        sensor_ID=name, date=date, sensor_water_level_adj=level, alert_threshold=alert, road_elevation=road, **more
    )


@pytest.mark.parametrize(
    "minute, state",
    [("11:20:00", "WARNING"), ("11:19:00.000001", "WARNING"), ("11:19:00", "FLOODING"),
     ("09:00:00.000001", "FLOODING"), ("09:00:00", "UNKNOWN"), ("12:00:30", "WARNING")],
)
def test_age_limits(frame, minute, state):
    df = frame(READINGS, [sensor("A", f"2024-01-30 {minute}", 1.5)])
    assert status.flood_status(df, NOW).first()["flood_status"] == state


def test_only_the_newest_reading_counts_whatever_its_flag(frame):
    rows = [
        sensor("A", AGES["silent"], 5.0),
        sensor("A", AGES["current"], 0.0, qa_qc_flag=True),
        sensor("B", AGES["current"], 2.0, qa_qc_flag=False),
        sensor("C", AGES["down"], None, alert=None),
        sensor("D", AGES["current"], 0.5, alert=None),
        sensor("E", AGES["silent"], None, road=None),
    ]
    got = {r["sensor_ID"]: r["flood_status"] for r in status.flood_status(frame(READINGS, rows), NOW).collect()}
    assert got == {"A": "NOT FLOODING", "B": "FLOODING", "C": "UNKNOWN", "D": None, "E": None}


def test_tied_newest_readings_are_all_judged(frame):
    rows = [sensor("A", AGES["current"], level) for level in (0.0, 1.5, 3.0, 3.0)]
    got = sorted(r["flood_status"] for r in status.flood_status(frame(READINGS, rows), NOW).collect())
    assert got == ["FLOODING", "FLOODING", "NOT FLOODING", "WARNING"]


def test_no_readings_give_no_status(frame):
    assert status.flood_status(frame(READINGS, []), NOW).count() == 0


def test_lookback_is_optional(frame):
    df = frame(READINGS, [sensor("A", "2020-01-01 00:00:00", 0.0)])
    assert status.flood_status(df, NOW).first()["flood_status"] == "UNKNOWN"
    assert status.flood_status(df, NOW, lookback_days=90).count() == 0


def test_banner_and_colors(spark):
    states = ["NOT FLOODING", "UNKNOWN", "WARNING", "FLOODING", None]
    df = spark.createDataFrame(
        [(str(i), "now", s) for i, s in enumerate(states)],
        "sensor_ID STRING, time_since_measurement_text STRING, flood_status STRING",
    )
    banners = [tuple(r)[1:] for r in status.status_banner(df).orderBy("sensor_ID").collect()]
    assert banners == [
        ("success", "Roadway Flood Status: NOT FLOODING, now"),
        ("gray", "Roadway Flood Status: UNKNOWN, now"),
        ("warning", "Roadway Flood Status: WARNING now"),
        ("danger", "Roadway Flood Status: FLOODING, now"),
        (None, None),
    ]
    for grey, last in ((True, "grey"), (False, None)):
        rows = status.status_color(df, grey).orderBy("sensor_ID").collect()
        assert [r["flood_color"] for r in rows] == ["#28a745", "grey", "#ffc107", "#dc3545", last]


def test_missing_interval(frame):
    rows = [
        sensor("A", AGES["current"], 0.0, lat=1.0, lng=1.0),
        sensor("B", AGES["silent"], 0.0, lat=1.0, lng=1.0),
        sensor("C", "2023-01-01 00:00:00", 0.0, lat=1.0, lng=1.0),
    ]
    df = frame(READINGS, rows)
    sensors = latest.latest_sensors(df, NOW, 90)
    got = status.missing_interval(sensors, status.judged_sensors(df, NOW), NOW).collect()
    assert [(r["sensor_ID"], str(r["from_ts"]), str(r["to_ts"])) for r in got] == [
        ("B", "2024-01-30 11:00:00", "2024-01-30 12:00:00")
    ]


def random_readings(frame, seed, n):
    rng = random.Random(seed)
    levels = [None, 0.0, 1.5, 3.0]
    rows = []
    for _ in range(n):
        minute = rng.randrange(2000)
        rows.append(
            sensor(
                rng.choice("ABC"),
                f"2024-01-{10 + minute // 1440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:00",
                rng.choice(levels),
                alert=rng.choice([None, 1.0]),
            )
        )
    return frame(READINGS, rows)


@pytest.mark.parametrize("bucket", [600, 3600, 86400 * 30])
def test_timeline_agrees_with_status_at_any_moment(frame, bucket):
    readings = random_readings(frame, 7, 120).cache()
    line = timeline.status_timeline(readings, seconds=bucket).cache()
    for moment in ("2024-01-10 00:30:00", "2024-01-10 11:17:30", "2024-01-11 05:00:00", "2024-01-20 00:00:00"):
        seen = readings.where(F.col("date") <= F.lit(moment).cast("timestamp"))
        now = {tuple(r) for r in status.flood_status(seen, moment).select("sensor_ID", "flood_status").collect()}
        then = {tuple(r) for r in timeline.status_at(line, moment).collect()}
        assert then == now


def test_timeline_intervals_do_not_overlap_and_leave_no_hole(frame):
    line = timeline.status_timeline(random_readings(frame, 3, 60).dropDuplicates(["sensor_ID", "date"]))
    rows = line.orderBy("sensor_ID", "from_ts").collect()
    for a, b in zip(rows, rows[1:]):
        if a["sensor_ID"] == b["sensor_ID"]:
            assert a["to_ts"] == b["from_ts"]
        else:
            assert a["to_ts"] is None
    assert rows[-1]["to_ts"] is None
