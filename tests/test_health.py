from gaugelake.operators import health, latest
from gaugelake.plans import catalog
from gaugelake.schemas import CAMERAS, RAW, READINGS, SURVEYS
from gaugelake.sources.warehouse import Warehouse

NOW = "2024-01-30 12:00:00"
STATUS = "sensor_ID STRING, time_since_measurement BIGINT, time_since_measurement_text STRING, flood_status STRING"
LOCATED = CAMERAS + ", DateTimeOriginalUTC TIMESTAMP"
THEN = "2024-01-30 11:00:00"


def test_camera_age_limits(frame):
    photos = {"09": "2024-01-30 11:50:00.000001", "10": "2024-01-30 11:50:00", "11": "2024-01-30 11:49:00", "none": None}
    df = frame(LOCATED, [dict(camera_ID=c, DateTimeOriginalUTC=t) for c, t in photos.items()])
    got = {r["camera_ID"]: (r["age"], r["label"]) for r in health.camera_health(df, NOW).collect()}
    assert got == {"09": (9, "Good!"), "10": (10, "Bad!"), "11": (11, "Bad!"), "none": (None, "Bad!")}


def raw_join(frame, natural):
    sensors = frame(READINGS, [dict(sensor_ID="A", place="X", voltage=4.0), dict(sensor_ID="B", place=None, voltage=None),
                               dict(sensor_ID="C", place="X", voltage=4.0)])
    raw = frame(RAW, [dict(sensor_ID="A", place="X", voltage=4.02, processed=True, date=THEN),
                      dict(sensor_ID="B", place=None, voltage=None, processed=False, date=THEN)])
    joined = health.join_raw(sensors, latest.latest_raw(raw), natural)
    return {r["sensor_ID"]: r["processed"] for r in joined.collect()}


def test_natural_join_includes_the_voltage(frame):
    assert raw_join(frame, True) == {"A": None, "B": False, "C": None}
    assert raw_join(frame, False) == {"A": True, "B": False, "C": None}


def flags(frame, state, photo, raw_date=THEN, processed=True):
    sensors = frame(READINGS, [dict(sensor_ID="A_1", place="X", voltage=4.0, date=THEN)])
    status = frame(STATUS, [dict(sensor_ID="A_1", flood_status=state)])
    raw = frame(RAW, [dict(sensor_ID="A_1", place="X", voltage=4.0, processed=processed, date=raw_date)])
    cameras = frame(
        LOCATED,
        [dict(camera_ID="CAM_A_1", place="X", DateTimeOriginalUTC=photo),
         dict(camera_ID="CAM_A_1", place="elsewhere", DateTimeOriginalUTC=NOW)],
    )
    rows = health.sensor_health(sensors.join(status, "sensor_ID", "left"), latest.latest_raw(raw), health.camera_health(cameras, NOW)).collect()
    assert len(rows) == 1
    return tuple(rows[0][c] for c in ("label", "no_data_error", "gateway_error", "processing_error"))


def test_sensor_health(frame):
    nine, ten, eleven = ("2024-01-30 11:51:00", "2024-01-30 11:50:00", "2024-01-30 11:49:00")
    assert flags(frame, "NOT FLOODING", nine) == ("Good!", False, False, False)
    assert flags(frame, "UNKNOWN", nine) == ("Bad!", True, False, False)
    assert flags(frame, "UNKNOWN", ten) == ("Bad!", False, False, False)
    assert flags(frame, "WARNING", eleven, processed=False) == ("Bad!", False, True, True)
    assert flags(frame, "FLOODING", nine, raw_date="2024-01-30 10:00:00") == ("Bad!", False, False, False)
    assert flags(frame, "FLOODING", None, processed=None) == ("Bad!", None, None, None)
    assert flags(frame, None, nine, processed=False) == ("Bad!", None, False, None)  # missing AND false


def test_every_sensor_of_a_place_finds_its_camera(frame):
    sensors = frame(READINGS, [dict(sensor_ID=s, place="X", voltage=4.0, date=THEN) for s in ("A", "B")])
    status = frame(STATUS, [dict(sensor_ID=s, flood_status="UNKNOWN") for s in ("A", "B")])
    raw = frame(RAW, [dict(sensor_ID=s, place="X", voltage=4.0, date=THEN) for s in ("A", "B")])
    cameras = frame(LOCATED, [dict(camera_ID=f"CAM_{s}", place="X", DateTimeOriginalUTC=NOW) for s in ("A", "B")])
    got = health.sensor_health(sensors.join(status, "sensor_ID", "left"), latest.latest_raw(raw), health.camera_health(cameras, NOW))
    assert {r["sensor_ID"]: r["no_data_error"] for r in got.collect()} == {"A": True, "B": True}


def test_battery(frame):
    volts = [3.6, 3.59, 3.4, 3.39, 6.0, 3.0, None]
    df = frame(READINGS, [dict(sensor_ID=str(i), voltage=v) for i, v in enumerate(volts)])
    got = [tuple(r)[2:] for r in health.battery_band(df).orderBy("sensor_ID").collect()]
    assert got == [
        (3.6, "good", "#55BF3B"), (3.59, "low", "#DDDF0D"), (3.4, "low", "#DDDF0D"), (3.39, "critical", "#DF5353"),
        (5.4, "good", "#55BF3B"), (3.2, "critical", "#DF5353"), (None, None, None),
    ]


def test_panel_counts_places_without_sensors_or_cameras(frame):
    shape = "place STRING, sensor_ID STRING, label STRING, time_since_measurement_text STRING, flood_status STRING"
    sensors = frame(shape, [dict(place="X", sensor_ID=s, label="Good!") for s in "AB"] + [dict(sensor_ID="N")])
    cameras = frame("place STRING, camera_ID STRING, label STRING, age_text STRING",
                    [dict(place="X", camera_ID="c"), dict(place="Z", camera_ID="d")])
    got = {(r["place"], r["kind"], r["id"]): (r["n_sensors"], r["n_cameras"]) for r in health.place_panel(sensors, cameras).collect()}
    assert got == {
        ("X", "sensor", "A"): (2, 1), ("X", "sensor", "B"): (2, 1), ("X", "camera", "c"): (2, 1),
        ("Z", "camera", "d"): (0, 1), (None, "sensor", "N"): (1, 0),
    }


def test_ties_stay_linear(spark, frame):
    """3,000 copies of the newest reading, raw row and photo give 3,000 rows each."""
    n = 3_000
    many = spark.range(n)
    row = dict(sensor_ID="A", place="X", date="2024-01-30 11:59:00", lat=1.0, lng=1.0, voltage=4.0,
               sensor_water_level_adj=0.0, alert_threshold=1.0, road_elevation=2.0)
    readings = frame(READINGS, [row]).crossJoin(many.select()).repartition(4)
    raw = frame(RAW, [dict(sensor_ID="A", place="X", date=THEN, voltage=4.0, processed=True)]).crossJoin(many.select())
    surveys = frame(SURVEYS, [dict(sensor_ID="A", date_surveyed=THEN, sensor_label="L")])
    cameras = frame(CAMERAS, [dict(camera_ID="CAM_A", sensor_ID="A", camera_label="C", place="X")])
    photos = frame("camera_ID STRING, DateTimeOriginalUTC TIMESTAMP", [dict(camera_ID="CAM_A", DateTimeOriginalUTC=THEN)])
    w = Warehouse(readings, raw, surveys, None, cameras, photos.crossJoin(many.select()))
    assert catalog.sensor_map_rows(w).count() == n
    assert catalog.camera_map_rows(w).count() == n
    sensors, located = catalog.health_rows(w)
    assert sensors.count() == n
    assert health.place_panel(sensors, located).count() == 2 * n
    for natural in (True, False):
        assert health.join_raw(catalog.mapped_rows(w), latest.latest_raw(raw), natural).count() == n
