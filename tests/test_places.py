import pytest
from pyspark.sql import functions as F

from gaugelake import schemas
from gaugelake.operators import links, places

MAPPED = "sensor_ID STRING, place STRING, lat DOUBLE, lng DOUBLE"


# Expected markup and wording in the tests below.

def test_sensor_map(frame):
    sensors = frame(schemas.READINGS, [dict(sensor_ID="A", date="2024-01-30 05:00:00", road_water_level_adj=-2.0),
                                       dict(sensor_ID="unlabelled", date="2024-01-30 05:00:00")])
    labels = frame("sensor_ID STRING, sensor_label STRING", [dict(sensor_ID="A", sensor_label="Dock")])
    row = places.sensor_map(sensors, labels).collect()
    assert len(row) == 1
    assert row[0]["sensor_label"] == "Dock (A)"
    assert row[0]["popup"] == (
        '<div><h4 align="center"><strong>Dock<br> (A)</h4></strong><h5 align="center">Last level:</h5>'
        '<h4 align="center">-2</h4><p align="center">12:00 AM EST - Jan 30, 2024</p>'
        '<p align="center">Click to view data at this site</p></div>'
    )


def test_camera_map_without_photo(frame):
    cameras = frame(schemas.CAMERAS, [dict(camera_ID="CAM_A", camera_label="Pier")])
    photos = frame(schemas.PHOTOS, [])
    row = places.camera_map(places.camera_locations(cameras, photos)).first()
    assert row["camera_label"] == "Pier (CAM_A)"
    assert '<p align="center">NA - NA</p>' in row["popup"]
    assert row["popup"].count("Click to view this camera") == 1


def test_view_popup_drops_the_hint(value):
    popup = f"a{places.SENSOR_HINT}b"
    assert value(places.view_popup(F.lit(popup))) == "ab"
    assert value(places.view_popup(F.lit(f"a{places.CAMERA_HINT}b"))) == "ab"


def test_place_list_keeps_order_of_appearance(frame):
    sensors = frame(MAPPED, [dict(sensor_ID=i, place=p) for i, p in (("B", "Y"), ("A", "X"), ("C", "X"))])
    cameras = frame(schemas.CAMERAS, [dict(camera_ID=i, place=p) for i, p in (("c1", "X"), ("c0", "Z"))])
    rows = places.place_list(sensors, cameras).orderBy("camera_only", "first_id").collect()
    assert [r["place"] for r in rows] == ["X", "Y", "Z"]


def test_place_view_prefers_sensors(frame):
    sensors = frame(MAPPED, [dict(sensor_ID=i, place="X", lat=l, lng=2 * l) for i, l in (("A", 1.0), ("B", 2.0))])
    cameras = frame(
        schemas.CAMERAS,
        [dict(camera_ID="1", place="X", lat=9.0, lng=9.0), dict(camera_ID="2", place="Hawaii", lat=5.0, lng=6.0),
         dict(camera_ID="3", place="Down East, North Carolina")],
    )
    got = {r["place"]: (r["lng"], r["lat"], r["zoom"]) for r in places.place_view(sensors, cameras).collect()}
    assert got == {
        "X": (3.0, 1.5, 16), "Hawaii": (6.0, 5.0, 11), "Down East, North Carolina": (None, None, 11),
    }


def test_start_view_without_place(spark):
    df = spark.createDataFrame(
        [(None, 1.0, 1.0, 16), ("", 1.0, 1.0, 16), ("X", 1.0, 1.0, 16)],
        "place STRING, lng DOUBLE, lat DOUBLE, zoom INT",
    )
    got = [tuple(r)[1:] for r in places.start_view(df).collect()]
    assert got == [(-77.360784, 34.576053, 8)] * 2 + [(1.0, 1.0, 16)]


def test_choices_name_a_default(frame):
    df = frame("place STRING, sensor_ID STRING, sensor_label STRING",
               [dict(place="X", sensor_ID=i, sensor_label=f"l{i}") for i in "BAC"] + [dict(sensor_ID="D")])
    got = places.place_choices(df, "sensor_ID", "sensor_label").collect()
    assert {r["id"]: r["is_default"] for r in got} == {"A": True, "B": False, "C": False, "D": True}


def test_site_rules_use_plain_substrings(frame):
    df = frame(MAPPED, [dict(sensor_ID="DE_1", place="Carolina Beach, North Carolina"),
                        dict(sensor_ID="ADE", place="North Carolina Beach"), dict(sensor_ID="X", place="Y")])
    got = {r["sensor_ID"]: (r["valve_tab"], r["guide"].split(" is installed ")[1][:6]) for r in places.site_rules(df).collect()}
    assert got == {"DE_1": (True, "on the"), "ADE": (True, "on the"), "X": (False, "in a s")}


def test_site_notes(frame):
    df = frame("sensor_ID STRING, notes STRING", [dict(sensor_ID=str(i), notes=n) for i, n in enumerate(["NA", None, "May"])])
    got = [r["note"] for r in places.site_notes(df).orderBy("sensor_ID").collect()]
    assert got == [None, None, "Sensor Installation Date: May"]


@pytest.mark.parametrize(
    "url, sensor, place",
    [("https://x.org/?sensor_ID=A", "A", None), ("https://x.org/?location=Down%20East%2C+NC&sensor_ID=B", "B", "Down East, NC"),
     ("https://x.org/", None, None), ("not a url %%%", None, None)],
)
def test_link_parameters(spark, url, sensor, place):
    row = links.parse_links(spark.createDataFrame([(1, url)], "link_id INT, url STRING")).first()
    assert (row["sensor_ID"], row["location"]) == (sensor, place)


def test_links_resolve(spark, frame):
    parsed = spark.createDataFrame(
        [(1, "A", None), (2, "tied", "X"), (3, "none", None), (4, None, "X"), (5, None, "gone"), (6, None, None), (7, "A", "X")],
        "link_id INT, sensor_ID STRING, location STRING",
    )
    surveys = frame(
        schemas.SURVEYS,
        [dict(sensor_ID="A", lng=1.0, lat=2.0)] + [dict(sensor_ID="tied", lng=1.0, lat=2.0)] * 2,
    )
    views = spark.createDataFrame([("X", 3.0, 4.0, 16)], "place STRING, lng DOUBLE, lat DOUBLE, zoom INT")
    got = {r["link_id"]: tuple(r)[1:] for r in links.resolve_links(parsed, surveys, views).collect()}
    assert got == {
        1: (1.0, 2.0, 20, None), 2: (None, None, None, None), 3: (None, None, None, None),
        4: (3.0, 4.0, 16, "X"), 5: (None, None, None, "gone"), 6: (None, None, None, None), 7: (1.0, 2.0, 20, None),
    }
