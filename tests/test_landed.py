"""Answers and downloads as files."""

import os
from collections import Counter

import pytest
from data import DATA

from gaugelake.operators import latest
from gaugelake.plans.catalog import QUERIES
from gaugelake.schemas import GAUGE_KEY, READINGS, SURVEYS
from gaugelake.sources import export, gauge_key, landed, payloads, testdata
from gaugelake.sources.named_files import write_named


def put(root, folder, name, text):
    os.makedirs(f"{root}/{folder}", exist_ok=True)
    with open(f"{root}/{folder}/{name}", "wb") as file:
        file.write(text if isinstance(text, bytes) else text.encode())


ASKED = "id={}/type={}/days=20240101_20240102"


def test_tide_files_and_rejects(spark, tmp_path):
    root = str(tmp_path)
    good = '{"metadata": {"id": "1"},\n "data": [{"t": "2024-01-01 00:00", "v": "1.5"},\n {"t": "2024-01-01 00:06", "v": ""}]}'
    put(root, ASKED.format("8658163", "obs"), "answer.json", good)
    put(root, ASKED.format("8658163", "pred") + "/more", "b.json", '{"predictions": [{"t": "2024-01-01 00:00", "v": "2"}]}')
    put(root, ASKED.format("007", "obs"), "cut.json", good[:60])
    put(root, ASKED.format("3", "obs"), "none.json", '{"error": {"message": "No data was found."}}')
    put(root, ASKED.format("4", "obs"), "other.json", '{"predictions": [{"t": "2024-01-01 00:00", "v": "2"}]}')
    put(root, ASKED.format("5", "obs"), "bytes.json", b"\xff\xfe\x00\x01")
    put(root, ASKED.format("6", "obs"), "list.json", "[1, 2]")
    put(root, "id=9/type=obs/days=soon", "x.json", good)
    documents = landed.read_documents(spark, root)
    assert documents.count() == 8
    rows = payloads.tide_rows(documents.where("id IS NOT NULL"), "obs", "pred").collect()
    # What could be read of a document that is cut short is not taken.
    assert sorted((str(r["date"])[11:16], str(r["level"])) for r in rows) == [
        ("00:00", "1.5"), ("00:00", "2.0"), ("00:06", "None"),
    ]
    assert {r["id"] for r in rows} == {"8658163"}
    rejects = {r["path"].rsplit("/", 1)[1]: (r["id"], r["reason"]) for r in landed.tide_file_rejects(documents).collect()}
    assert rejects == {
        "cut.json": ("007", "unreadable"), "none.json": ("3", "empty"), "other.json": ("4", "empty"),
        "bytes.json": ("5", "unreadable"), "list.json": ("6", "unreadable"), "x.json": (None, "path"),
    }
    first = documents.where("id = '007'").first()
    assert (str(first["first_day"]), str(first["last_day"])) == ("2024-01-01", "2024-01-02")
    assert payloads.asked_between(documents, "2024-01-03", "2024-01-04").where("id IS NOT NULL").count() == 0


def test_one_broken_gauge_file_among_good_ones(spark, tmp_path):
    root = str(tmp_path)
    point = "<general><data_time>2024-01-01 00:0{}:00</data_time><data_value>{}</data_value></general>"
    answer = "<onerain><response>{}</response></onerain>"
    for n in range(3):
        put(root, ASKED.format(f"G{n}", "obs"), "a.xml", answer.format(point.format(n, n) + point.format(n + 1, "x")))
    put(root, ASKED.format("G3", "obs"), "a.xml", answer.format(point.format(1, 2).replace("</data_time>", "")))
    put(root, ASKED.format("G4", "obs"), "a.xml", "service is down")
    put(root, ASKED.format("G5", "obs"), "a.xml", answer.format("<message>none</message>"))
    put(root, "stray", "a.xml", answer.format(point.format(1, 1)))
    rows = landed.gauge_file_rows(spark, root).collect()
    assert sorted((r["id"], r["level"]) for r in rows if r["level"] is not None) == [("G0", 0.0), ("G1", 1.0), ("G2", 2.0)]
    assert len(rows) == 6
    rejects = sorted((r["id"] or "", r["reason"]) for r in landed.gauge_file_rejects(spark, root).collect())
    assert rejects == [("", "path"), ("G3", "unreadable"), ("G4", "unreadable"), ("G5", "empty")]


def test_documents_written_are_documents_read(spark, tmp_path):
    rows = [(str(n % 3), "obs", f'{{"data": []}} {n}\né') for n in range(7)]
    df = spark.createDataFrame(rows, "id STRING, type STRING, payload STRING").selectExpr(
        "*", "DATE '2024-01-05' AS first_day", "DATE '2024-01-06' AS last_day"
    )
    landed.write_documents(df, str(tmp_path / "out"), spread=2)
    found = landed.read_documents(spark, str(tmp_path / "out")).collect()
    assert sorted((r["id"], r["type"], r["payload"].removesuffix("\n")) for r in found) == sorted(rows)
    assert {(str(r["first_day"]), str(r["last_day"])) for r in found} == {("2024-01-05", "2024-01-06")}


def test_tied_surveys_and_keys_stay_linear(spark, frame):
    surveys = frame(SURVEYS, [dict(sensor_ID="A", wl_id="X", date_surveyed="2024-01-01 00:00:00", notes=str(n)) for n in range(3000)])
    key = [dict(site_id="X", Sensor="Water Elevation", gauge_sensor_id=str(n % 10)) for n in range(100)]
    found = gauge_key.gauge_lookup(frame(GAUGE_KEY, key), surveys).collect()
    assert sorted(r["gauge_sensor_id"] for r in found) == [str(n) for n in range(10)]


def test_every_tied_survey_meets_every_key(spark, frame):
    surveys = [dict(sensor_ID="A", wl_id="X", notes=str(n)) for n in range(3)] + [dict(sensor_ID="B", wl_id="Y")]
    key = [dict(site_id="X", Sensor="Water Elevation", gauge_sensor_id=k) for k in ("1", "HG", "HG")]
    key += [dict(site_id="X", Sensor="Battery", gauge_sensor_id="2"), dict(site_id="Y", Sensor="Water Elevation")]
    found = gauge_key.survey_keys(frame(GAUGE_KEY, key), frame(SURVEYS, surveys)).collect()
    assert Counter(map(tuple, found)) == {("A", "X", "1"): 3, ("A", "X", "HG"): 6, ("B", "Y", None): 1}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_the_lookup_drops_no_survey_and_no_key(spark, scale):
    """As many rows as newest surveys have water-elevation rows of their gauges, counted one by one."""
    folder = f"{DATA}/{scale}"
    keys = Counter(
        r["site_id"] for r in QUERIES["q_gauge_key"](spark, folder).collect() if r["Sensor"] == "Water Elevation"
    )
    newest = latest.latest_surveys(testdata.load(spark, folder).surveys).collect()
    assert QUERIES["q_gauge_lookup"](spark, folder).count() == sum(keys[r["wl_id"]] for r in newest)


def test_named_files_are_ordered_and_exact(spark, frame, tmp_path):
    rows = [
        dict(sensor_ID=s, date=f"2024-01-{1 + (n * 7) % 28:02} 06:00:00", sensor_elevation=1.0, sensor_water_level_adj=n / 8)
        for s in ("CB_01", "BF_02") for n in range(40)
    ]
    rows.append(dict(rows[0], sensor_ID=None))
    path = str(tmp_path / "out")
    for _ in range(2):  # written again, the files are replaced
        export.write_named_download(frame(READINGS, rows).repartition(5), "2024-01-01", "2024-01-31", path)
        assert sorted(os.listdir(path)) == ["BF_02_20240101_20240131.csv", "CB_01_20240101_20240131.csv"]
    with open(f"{path}/CB_01_20240101_20240131.csv") as file:
        lines = file.read().splitlines()
    assert lines[0] == ",".join(export.HEADINGS.values()) and len(lines) == 41
    assert lines[1:] == sorted(lines[1:]) and lines[1].split(",")[2] == "NA"
    numbered = export.read_named_lines(spark, path).where("file LIKE 'CB%'").orderBy("line").collect()
    assert [r["text"] for r in numbered] == lines and numbered[0]["line"] == 0
    export.write_named_download(frame(READINGS, []), "2024-01-01", "2024-01-31", str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


def test_nothing_is_seen_after_a_failed_task(spark, tmp_path):
    lines = spark.range(100).selectExpr(
        "CASE WHEN id = 77 THEN 'a/b' ELSE concat('f', CAST(id % 5 AS STRING)) END AS file", "CAST(id AS STRING) AS line"
    )
    with pytest.raises(Exception, match="not a file name"):
        write_named(lines.repartition(4, "file").sortWithinPartitions("file"), str(tmp_path / "out"))
    # A task that still ran when the job failed may leave something in the hidden folder.
    left = os.listdir(tmp_path / "out") if os.path.exists(tmp_path / "out") else []
    assert [name for name in left if not name.startswith("_")] == []
