"""Table schemas (Spark DDL) and the fixed numbers of the domain.

All instants are TIMESTAMP read in a UTC session; levels are feet.
"""

READINGS = (
    "place STRING, sensor_ID STRING, date TIMESTAMP, lat DOUBLE, lng DOUBLE, "
    "sensor_elevation DOUBLE, road_elevation DOUBLE, alert_threshold DOUBLE, "
    "sensor_water_level DOUBLE, road_water_level DOUBLE, "
    "sensor_water_level_adj DOUBLE, road_water_level_adj DOUBLE, "
    "voltage DOUBLE, qa_qc_flag BOOLEAN"
)
RAW = "place STRING, sensor_ID STRING, date TIMESTAMP, voltage DOUBLE, processed BOOLEAN"
SURVEYS = (
    "sensor_ID STRING, date_surveyed TIMESTAMP, sensor_label STRING, lat DOUBLE, lng DOUBLE, "
    "reference_elevation DOUBLE, reference_elevation_type STRING, "
    "wl_id STRING, wl_src STRING, wl_types STRING, wl_url STRING, "
    "alt_wl_id STRING, alt_wl_src STRING, alt_wl_types STRING, alt_wl_url STRING, notes STRING"
)
PROVIDER = "id STRING, date TIMESTAMP, value DOUBLE, api_name STRING, type STRING"
CAMERAS = (
    "camera_ID STRING, sensor_ID STRING, camera_label STRING, place STRING, lat DOUBLE, lng DOUBLE"
)
PHOTOS = "camera_ID STRING, DateTimeOriginalUTC TIMESTAMP"
# Landed service answers: one document per row with the request it answers. The days asked
# for (UTC, inclusive) may be missing.
PAYLOADS = "id STRING, type STRING, payload STRING, first_day DATE, last_day DATE"
GAUGE_KEY = (
    "place STRING, location STRING, site_id STRING, or_site_id INT, "
    "Sensor STRING, gauge_sensor_id STRING, or_sensor_id INT"
)
TIDE_JSON = (
    "data ARRAY<STRUCT<t: STRING, v: STRING>>, predictions ARRAY<STRUCT<t: STRING, v: STRING>>"
)
GAUGE_XML = "response STRUCT<general: ARRAY<STRUCT<data_time: STRING, data_value: STRING>>>"

# Fixed values.
LOCAL_ZONE = "America/New_York"
CURRENT_MINUTES = 40
DOWN_MINUTES = 180
CAMERA_MINUTES = 10
GAP_MS = 2_160_000
DRY_BAND_FT = 1 / 6
LOOKBACK_DAYS = 90
READINGS_PER_DAY = 10 * 24
MAX_REQUEST_READINGS = 7440
MAX_OVERLAY_DAYS = 30
WATER_LEVEL = "water_level"
