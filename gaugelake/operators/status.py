"""Roadway flood status and what is derived from it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.clock import age_minutes, age_text, instant
from gaugelake.operators.latest import newest_rows
from gaugelake.schemas import CURRENT_MINUTES, DOWN_MINUTES
from gaugelake.sources.warehouse import DAY, on_days

# Box style and map colour of each status.
SEVERITY = {
    "NOT FLOODING": "success",
    "UNKNOWN": "gray",
    "WARNING": "warning",
    "FLOODING": "danger",
}
COLORS = {
    "UNKNOWN": "grey",
    "FLOODING": "#dc3545",
    "WARNING": "#ffc107",
    "NOT FLOODING": "#28a745",
}


def current_status(alert: Column, road: Column) -> Column:
    """Status while readings arrive. Unknown comparisons leave it NULL."""
    return (
        F.when(alert.isNull() | road.isNull(), F.lit(None).cast("string"))
        .when(road, "FLOODING")
        .when(alert, "WARNING")
        .otherwise("NOT FLOODING")
    )


def silent_status(alert: Column, road: Column) -> Column:
    """Status in the silence after a reading: a drowned sensor cannot transmit.

    Below the alert level silence says nothing; above it, it means flooding. The road
    comparison does not change the answer, but while unknown it leaves it NULL.
    """
    return (
        F.when(alert.isNotNull() & ~alert, "UNKNOWN")
        .when(alert.isNull() | road.isNull(), F.lit(None).cast("string"))
        .otherwise("FLOODING")
    )


def status_of(alert: Column, road: Column, current: Column, down: Column) -> Column:
    """Status from the four facts; once communications are down nothing else counts."""
    return (
        F.when(down, "UNKNOWN")
        .when(current, current_status(alert, road))
        .otherwise(silent_status(alert, road))
    )


def above_alert() -> Column:
    return F.col("sensor_water_level_adj") >= F.col("alert_threshold")


def above_road() -> Column:
    return F.col("sensor_water_level_adj") >= F.col("road_elevation")


def judge(
    newest: DataFrame, as_of, current_min: int = CURRENT_MINUTES, down_min: int = DOWN_MINUTES
) -> DataFrame:
    """Age and status of rows that are already each sensor's newest."""
    age = F.col("time_since_measurement")
    return (
        newest.withColumn("time_since_measurement", age_minutes(as_of, "date"))
        .withColumn("time_since_measurement_text", age_text(age))
        .withColumn("is_current", age <= current_min)
        .withColumn("is_comms_down", age >= down_min)
        .withColumn(
            "flood_status",
            status_of(above_alert(), above_road(), F.col("is_current"), F.col("is_comms_down")),
        )
    )


def judged_sensors(
    readings: DataFrame,
    as_of,
    current_min: int = CURRENT_MINUTES,
    down_min: int = DOWN_MINUTES,
    lookback_days: int | None = None,
) -> DataFrame:
    """``judge`` on the newest readings of all sensors, whatever their quality flag.

    The whole history counts by default. ``lookback_days`` bounds the scan where older
    sensors may be left out.
    """
    if lookback_days is not None:
        first = F.date_sub(instant(as_of).cast("date"), lookback_days)
        readings = on_days(readings, first).where(F.col("date") > first.cast("timestamp"))
    names = ["sensor_ID", "date", "sensor_water_level_adj", "alert_threshold", "road_elevation"]
    facts = readings.select(*names, *(c for c in readings.columns if c == DAY))
    return judge(newest_rows(facts, ["sensor_ID"], "date"), as_of, current_min, down_min)


STATUS_COLUMNS = ["sensor_ID", "time_since_measurement", "time_since_measurement_text", "flood_status"]


def flood_status(readings: DataFrame, as_of, **limits) -> DataFrame:
    """Flood status per sensor at ``as_of``; a sensor with tied newest rows has several."""
    return judged_sensors(readings, as_of, **limits).select(*STATUS_COLUMNS)


def _mapped(values: dict[str, str], key: Column) -> Column:
    chain = F.lit(None).cast("string")
    for known, value in values.items():
        chain = F.when(key == known, value).otherwise(chain)
    return chain


def status_banner(status: DataFrame) -> DataFrame:
    """Box style and title per sensor. The warning title has no comma."""
    state = F.col("flood_status")
    comma = F.when(state == "WARNING", " ").otherwise(", ")
    title = F.concat(
        F.lit("Roadway Flood Status: "), state, comma, F.col("time_since_measurement_text")
    )
    return status.select("sensor_ID", _mapped(SEVERITY, state).alias("severity"), title.alias("title"))


def status_color(df: DataFrame, grey_when_missing: bool) -> DataFrame:
    """Add ``flood_color``. Only camera markers turn grey without a status."""
    state = F.col("flood_status")
    color = _mapped(COLORS, state)
    if grey_when_missing:
        color = F.when(state.isNull(), COLORS["UNKNOWN"]).otherwise(color)
    return df.withColumn("flood_color", color)


def missing_interval(sensors: DataFrame, judged: DataFrame, as_of) -> DataFrame:
    """The unreported stretch of sensors that are not current.

    It starts at the newest reading of the map table, which has its own lookback.
    """
    silent = judged.where(~F.col("is_current")).select("sensor_ID").distinct()
    return (
        sensors.select("sensor_ID", F.col("date").alias("from_ts"))
        .distinct()
        .join(silent, "sensor_ID", "left_semi")
        .withColumn("to_ts", instant(as_of))
    )
