"""Map rows, places and what is shown per place."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.clock import clock_text, local_time
from gaugelake.functions.text import drop_first, glue, number_text
from gaugelake.operators.latest import latest_photos
from gaugelake.settle import settle

# The start view of the map, zooms, and places spread over a wide area.
START_VIEW = (-77.360784, 34.576053, 8)
SITE_ZOOM, WIDE_ZOOM, SENSOR_ZOOM, POPUP_ZOOM = 16, 11, 20, 18
WIDE_PLACES = ("Down East, North Carolina", "Hawaii")

# Popup markup.
OPEN = '<div><h4 align="center"><strong>'
HEAD_END = "</h4></strong>"
LEVEL = '<h5 align="center">Last level:</h5><h4 align="center">'
PICTURE = '<h5 align="center">Last picture:</h5>'
TIME = '<p align="center">'
SENSOR_HINT = '<p align="center">Click to view data at this site</p>'
CAMERA_HINT = '<p align="center">Click to view this camera</p>'
CLOSE = "</div>"

# Guide texts.
ROADSIDE_GUIDE = (
    "This water level sensor is installed on the side of a road just above ground level. "
    "Measurements from our sensor (the blue line on the data plot) above the dashed red line "
    "indicate flooding on the road."
)
DRAIN_GUIDE = (
    "This water level sensor is installed in a storm drain. Measurements from our sensor "
    "(the blue line) above the red dotted line indicate flooding on the road."
)
INSTALLED = "Sensor Installation Date: "


def _titled(label: str, key: str) -> tuple[Column, Column]:
    """The plain label and the two-line label of a site."""
    plain = glue(F.col(label), " (", F.col(key), ")")
    return plain, glue(F.col(label), "<br> (", F.col(key), ")")


def sensor_map(sensors: DataFrame, labels: DataFrame) -> DataFrame:
    """Map rows of the newest readings with label and popup; unlabelled sensors drop out."""
    plain, lines = _titled("sensor_label", "sensor_ID")
    popup = glue(
        OPEN, lines, HEAD_END, LEVEL, number_text(F.col("road_water_level_adj"), 2),
        "</h4>", TIME, clock_text("date"), "</p>", SENSOR_HINT, CLOSE,
    )
    return sensors.join(labels, "sensor_ID").withColumns(
        {"date_lst": local_time("date"), "sensor_label": plain, "popup": popup}
    )


def camera_locations(cameras: DataFrame, photos: DataFrame) -> DataFrame:
    """All cameras with their newest photo, if any."""
    return cameras.join(latest_photos(photos), "camera_ID", "left")


def camera_map(located: DataFrame) -> DataFrame:
    """Label and popup of every camera."""
    plain, lines = _titled("camera_label", "camera_ID")
    popup = glue(
        OPEN, lines, HEAD_END, PICTURE, TIME, clock_text("DateTimeOriginalUTC"), "</p>",
        CAMERA_HINT, CLOSE,
    )
    return located.withColumns(
        {"date_lst": local_time("DateTimeOriginalUTC"), "camera_label": plain, "popup": popup}
    )


def view_popup(popup: Column) -> Column:
    """A popup opened from a chart page: without its hint to click."""
    return drop_first(drop_first(popup, SENSOR_HINT), CAMERA_HINT)


def camera_caption(newest_photos: DataFrame) -> DataFrame:
    return newest_photos.select("camera_ID", clock_text("DateTimeOriginalUTC").alias("caption"))


def place_list(sensors: DataFrame, cameras: DataFrame) -> DataFrame:
    """Distinct places of sensors and cameras in order of appearance.

    Sensor places come first (``camera_only`` false), by their first id.
    """
    seen = sensors.select("place", F.lit(False).alias("camera_only"), F.col("sensor_ID").alias("id"))
    seen = seen.unionByName(
        cameras.select("place", F.lit(True).alias("camera_only"), F.col("camera_ID").alias("id"))
    )
    first = F.min(F.struct("camera_only", "id")).alias("first")
    return (
        seen.groupBy("place")
        .agg(first)
        .select("place", "first.camera_only", F.col("first.id").alias("first_id"))
    )


def zoom_of(place: Column) -> Column:
    return F.when(place.isin(*WIDE_PLACES), WIDE_ZOOM).otherwise(SITE_ZOOM)


def place_view(sensors: DataFrame, cameras: DataFrame) -> DataFrame:
    """Centre and zoom per place: mean of its sensors, or of its cameras without sensors.

    A place without any coordinates has no centre.
    """

    def centre(df: DataFrame, flag: str) -> DataFrame:
        return df.groupBy("place").agg(
            F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.lit(True).alias(flag)
        )

    by_sensor = centre(sensors, "sensed")
    by_camera = centre(cameras, "seen").withColumnsRenamed({"lng": "cam_lng", "lat": "cam_lat"})
    both = by_sensor.join(by_camera, "place", "full")
    lng = F.when(F.col("sensed"), F.col("lng")).otherwise(F.col("cam_lng"))
    lat = F.when(F.col("sensed"), F.col("lat")).otherwise(F.col("cam_lat"))
    return both.select(
        "place", lng.alias("lng"), lat.alias("lat"), zoom_of(F.col("place")).alias("zoom")
    )


def start_view(df: DataFrame) -> DataFrame:
    """Fill the start view where no place is selected (``place`` NULL or empty)."""
    lng, lat, zoom = START_VIEW
    unset = F.col("place").isNull() | (F.col("place") == "")
    return df.withColumns(
        {
            "lng": F.when(unset, lng).otherwise(F.col("lng")),
            "lat": F.when(unset, lat).otherwise(F.col("lat")),
            "zoom": F.when(unset, zoom).otherwise(F.col("zoom")),
        }
    )


def place_choices(entries: DataFrame, key: str, label: str) -> DataFrame:
    """The menu entries of each place as rows; the first by id is the default.

    Rows instead of one map per place, so that a place with very many entries is not
    gathered in one task.
    """
    defaults = entries.groupBy(F.col("place").alias("_place")).agg(F.min(key).alias("default_id"))
    same_place = F.col("place").eqNullSafe(F.col("_place"))
    return entries.join(settle(defaults, "defaults"), same_place).select(
        "place",
        F.col(key).alias("id"),
        F.col(label).alias("label"),
        (F.col(key) == F.col("default_id")).alias("is_default"),
    )


def site_rules(sensors: DataFrame) -> DataFrame:
    """Which pages and which guide a sensor gets."""
    roadside = F.col("sensor_ID").contains("DE")
    return sensors.select(
        "sensor_ID",
        F.col("place").contains("Carolina Beach").alias("valve_tab"),
        F.when(roadside, ROADSIDE_GUIDE).otherwise(DRAIN_GUIDE).alias("guide"),
    )


def site_notes(newest_surveys: DataFrame) -> DataFrame:
    """The installation note, NULL where the survey says ``NA``."""
    notes = F.col("notes")
    return newest_surveys.select(
        "sensor_ID", F.when(notes != "NA", F.concat(F.lit(INSTALLED), notes)).alias("note")
    )
