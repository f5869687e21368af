import pytest

from gaugelake import schemas
from gaugelake.operators import overlays

CONSTANTS = "sensor_ID STRING, sensor_elevation DOUBLE, road_elevation DOUBLE"


def survey(sensor, **more):
    base = dict(sensor_ID=sensor, wl_id="1", wl_src="FIMAN", wl_types="obs", wl_url="u", alt_wl_id="2",
                alt_wl_src="hohonu", alt_wl_types="obs", alt_wl_url="u")
    return {**base, **more}


def test_meta(frame):
    rows = [
        survey("CB_1", wl_url=None, alt_wl_url=""),
        survey("X", wl_types="obs, pred", alt_wl_url=None, alt_wl_types=None),
        survey("XCB_", wl_types=None),
        survey("Y", wl_types="observed"),
    ]
    got = {r["sensor_ID"]: r for r in overlays.overlay_meta(frame(schemas.SURVEYS, rows)).collect()}
    flags = ["primary_ok", "alt_ok", "default_on", "has_obs", "has_pred", "alt_has_obs"]
    assert [got["CB_1"][f] for f in flags] == [False, False, True, True, False, True]
    assert [got["X"][f] for f in flags] == [True, False, False, True, True, False]
    assert [got["XCB_"][f] for f in flags] == [True, True, True, False, False, True]
    assert got["Y"]["has_obs"] is False


def provider_rows():
    days = ["2024-01-09 23:59:59", "2024-01-10 00:00:00", "2024-01-12 00:00:00", "2024-01-12 00:00:01"]
    rows = [dict(id="1", date=d, value=3.0, api_name="FIMAN", type="water_level") for d in days]
    rows.append(dict(id="1", date=days[1], value=9.0, api_name="FIMAN", type="air_temperature"))
    rows.append(dict(id="2", date=days[1], value=4.0, api_name="HOHONU", type="water_level"))
    return rows


@pytest.mark.parametrize("days", [("2024-01-10", "2024-01-12"), ("2024-01-12", "2024-01-10")])
def test_stored_rows_use_a_closed_range(frame, days):
    got = overlays.provider_observations(frame(schemas.PROVIDER, provider_rows()), *days)
    assert sorted((r["id"], str(r["date"]), r["level"], r["notes"]) for r in got.collect()) == [
        ("1", "2024-01-10 00:00:00", 3.0, "observation"),
        ("1", "2024-01-12 00:00:00", 3.0, "observation"),
        ("2", "2024-01-10 00:00:00", 4.0, "observation"),
    ]


@pytest.fixture
def everything(spark, frame):
    provider = frame(schemas.PROVIDER, provider_rows())
    points = '[{"t": "2024-01-12 23:54", "v": "5.0"}, {"t": "2024-01-13 00:00", "v": "6.0"}]'
    tide = spark.createDataFrame(
        [("1", "obs", f'{{"data": {points}}}', None, None), ("1", "pred", f'{{"predictions": {points}}}', None, None)],
        schemas.PAYLOADS,
    )
    constants = frame(
        CONSTANTS, [dict(sensor_ID=s, sensor_elevation=0.0, road_elevation=2.0) for s in ("A", "B", "CB_9", "D")]
    )

    def run(kind, *rows):
        meta = overlays.overlay_meta(frame(schemas.SURVEYS, list(rows)))
        got = overlays.overlay_series(meta, constants, provider, tide, "2024-01-10", "2024-01-12", kind)
        return sorted(
            (r["sensor_ID"], str(r["date"]), r["road_water_level"], r["sensor_water_level"], r["entity"])
            for r in got.collect()
        )

    return run


def test_sources_are_named_in_any_case(everything):
    rows = [survey("A", wl_src="noaa"), survey("B", wl_src="Fiman"), survey("D", wl_src="elsewhere"),
            survey("unmapped")]
    assert everything("obs", *rows) == [
        ("A", "2024-01-12 23:54:00", 3.0, 5.0, "NOAA Observed"),  # the tide service's last day is whole
        ("B", "2024-01-10 00:00:00", 1.0, 3.0, "FIMAN"),
        ("B", "2024-01-12 00:00:00", 1.0, 3.0, "FIMAN"),
    ]


def test_predictions_and_alternates(everything):
    rows = [survey("A", wl_src="NOAA", wl_types="obs, pred"), survey("B", wl_types="pred", alt_wl_url="")]
    assert everything("pred", *rows) == [
        ("A", "2024-01-12 23:54:00", 3.0, 5.0, "NOAA Predictions"),
        ("B", "2024-01-10 00:00:00", 1.0, 3.0, "FIMAN"),  # stored providers ignore the kind
        ("B", "2024-01-12 00:00:00", 1.0, 3.0, "FIMAN"),
    ]
    assert everything("alt", *rows) == [("A", "2024-01-10 00:00:00", 2.0, 4.0, "HOHONU")]


def test_overlays_without_address_show_only_where_on_by_default(everything):
    rows = [survey("A", wl_url=None), survey("CB_9", wl_url=None)]
    assert {r[0] for r in everything("obs", *rows)} == {"CB_9"}


def test_tied_equal_surveys_do_not_double_the_overlay(everything):
    assert len(everything("obs", survey("B"), survey("B", notes="other"))) == 2
