"""Dashboard: sensor, camera and battery health, and the panels of each place."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.clock import age_minutes, age_text
from gaugelake.functions.text import drop_first
from gaugelake.schemas import CAMERA_MINUTES
from gaugelake.settle import settle

GOOD, BAD = "Good!", "Bad!"
CAMERA_PREFIX = "CAM_"

# Battery gauge range and colour stops in volts.
GAUGE_VOLTS = (3.2, 5.4)
BATTERY_STOPS = ((3.6, "good", "#55BF3B"), (3.4, "low", "#DDDF0D"), (3.3, "critical", "#DF5353"))


def join_raw(sensors: DataFrame, raw_newest: DataFrame, natural: bool = True) -> DataFrame:
    """Left join of sensors with their newest raw rows.

    Both sides carry ``place``, ``sensor_ID`` and ``voltage``; the natural join uses all
    three, so a raw row with another voltage stays unmatched. Missing values match each
    other. ``natural=False`` joins on place and sensor only. Copies of a raw row count once.
    """
    keys = ["place", "sensor_ID"] + (["voltage"] if natural else [])
    right = raw_newest.select(
        *(F.col(k).alias(f"_{k}") for k in keys), "processed", "raw_data_date"
    ).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sensors.join(right, same, "left").drop(*(f"_{k}" for k in keys))


def camera_health(located: DataFrame, as_of) -> DataFrame:
    """Age of each camera's newest photo. A camera without photos is bad."""
    age = F.col("age")
    return (
        located.withColumn("age", age_minutes(as_of, "DateTimeOriginalUTC"))
        .withColumn("age_text", F.when(age.isNotNull(), age_text(age)))
        .withColumn("label", F.when(age < CAMERA_MINUTES, GOOD).otherwise(BAD))
    )


def sensor_health(sensors: DataFrame, raw_newest: DataFrame, cameras: DataFrame) -> DataFrame:
    """Health and error flags per sensor row.

    ``sensors`` are map rows with their own status, from ``judge``; ``cameras`` is the result of
    ``camera_health``. Different facts of tied raw rows or photos give a row each, copies don't,
    so the rows stay in proportion to the sensors' however many copies there are. A sensor's camera is the one of its
    place whose id without the prefix is the sensor id. Flags are NULL where a needed fact
    is missing. A photo age of exactly the limit raises neither outage flag. Every sensor is
    matched with its camera, not only the first of a place.
    """
    partner = cameras.select(
        F.col("place").alias("_place"),
        drop_first(F.col("camera_ID"), CAMERA_PREFIX).alias("_sensor"),
        F.col("age").alias("camera_age"),
    ).distinct()
    mine = (F.col("place") == F.col("_place")) & (F.col("sensor_ID") == F.col("_sensor"))
    rows = join_raw(sensors, raw_newest).join(partner, mine, "left").drop("_place", "_sensor")
    state = F.col("flood_status")
    troubled = state != "NOT FLOODING"
    fresh = troubled & (F.col("raw_data_date") == F.col("date"))
    return rows.withColumns(
        {
            "label": F.when(state == "NOT FLOODING", GOOD).otherwise(BAD),
            "no_data_error": fresh & (F.col("camera_age") < CAMERA_MINUTES),
            "gateway_error": fresh & (F.col("camera_age") > CAMERA_MINUTES),
            "processing_error": troubled & (F.col("processed") == F.lit(False)),
        }
    )


def battery_band(sensors: DataFrame) -> DataFrame:
    """Voltage, the reading of the bounded gauge, band and colour."""
    volts = F.col("voltage")
    low, high = GAUGE_VOLTS
    (ok, ok_band, ok_color), (weak, weak_band, weak_color), (_, bad_band, bad_color) = BATTERY_STOPS

    def by_band(good, poor, bad):
        return F.when(volts >= ok, good).when(volts >= weak, poor).when(volts.isNotNull(), bad)

    needle = F.when(volts.isNotNull(), F.least(F.greatest(volts, F.lit(low)), F.lit(high)))
    return sensors.select(
        "sensor_ID",
        "voltage",
        needle.alias("needle"),
        by_band(ok_band, weak_band, bad_band).alias("band"),
        by_band(ok_color, weak_color, bad_color).alias("color"),
    )


def place_panel(sensors: DataFrame, cameras: DataFrame) -> DataFrame:
    """The dashboard as rows: one per sensor and camera, with the counts of their place.

    ``sensors`` come from ``sensor_health``, ``cameras`` from ``camera_health``. Rows instead
    of one nested value per place keep large places spread over many tasks; only the counts
    are gathered, after partial counting.
    """
    entries = sensors.select(
        "place",
        F.lit("sensor").alias("kind"),
        F.col("sensor_ID").alias("id"),
        "label",
        F.col("time_since_measurement_text").alias("age_text"),
        "flood_status",
    ).unionByName(
        cameras.select(
            "place",
            F.lit("camera").alias("kind"),
            F.col("camera_ID").alias("id"),
            "label",
            "age_text",
            F.lit(None).cast("string").alias("flood_status"),
        )
    )
    counts = entries.groupBy(F.col("place").alias("_place")).agg(
        F.count_if(F.col("kind") == "sensor").alias("n_sensors"),
        F.count_if(F.col("kind") == "camera").alias("n_cameras"),
    )
    same_place = F.col("place").eqNullSafe(F.col("_place"))
    return entries.join(settle(counts, "counts"), same_place).drop("_place")
