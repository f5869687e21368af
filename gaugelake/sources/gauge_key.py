"""The gauge key: which sensor number of a gauge measures the water level."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.schemas import GAUGE_KEY


def read_gauge_key(spark: SparkSession, path: str) -> DataFrame:
    """Read the key file. Its ids mix digits and letters; rows with no value are dropped."""
    return spark.read.schema(GAUGE_KEY).option("header", True).csv(path).dropna("all")


def parse_gauge_key(lines: DataFrame, column: str = "line") -> DataFrame:
    """The same from headerless lines held in a text column."""
    record = F.from_csv(F.col(column), GAUGE_KEY)
    return lines.select(record.alias("record")).select("record.*").dropna("all")


def water_elevation_keys(key: DataFrame) -> DataFrame:
    return key.where(F.col("Sensor") == "Water Elevation")


def gauge_lookup(key: DataFrame, surveys: DataFrame) -> DataFrame:
    """The water-elevation key of the gauge each survey names, each fact once.

    Both sides are reduced first: copies of tied surveys and of key rows don't multiply.
    """
    keys = water_elevation_keys(key).select(F.col("site_id").alias("wl_id"), "gauge_sensor_id").distinct()
    return surveys.select("sensor_ID", "wl_id").distinct().join(keys, "wl_id").select(
        "sensor_ID", "wl_id", "gauge_sensor_id"
    )


def survey_keys(key: DataFrame, surveys: DataFrame) -> DataFrame:
    """Every survey with every water-elevation row of the gauge it names; tied surveys and copies of keys are rows each."""
    keys = water_elevation_keys(key).select(F.col("site_id").alias("wl_id"), "gauge_sensor_id")
    return surveys.select("sensor_ID", "wl_id").join(keys, "wl_id").select("sensor_ID", "wl_id", "gauge_sensor_id")
