"""Deep links: a page address that selects a sensor or a place."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.operators.places import SENSOR_ZOOM
from gaugelake.settle import settle


def query_value(url: Column, name: str) -> Column:
    """A decoded parameter of an address, NULL when absent or unreadable."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def parse_links(links: DataFrame) -> DataFrame:
    """``link_id`` with the ``sensor_ID`` and ``location`` its ``url`` names."""
    return links.select(
        "link_id",
        query_value(F.col("url"), "sensor_ID").alias("sensor_ID"),
        query_value(F.col("url"), "location").alias("location"),
    )


def resolve_links(links: DataFrame, newest_surveys: DataFrame, views: DataFrame) -> DataFrame:
    """Where each link leads.

    A sensor leads to its newest survey's coordinates if that is a single row, else
    nowhere. Only without a sensor does a location count: it selects the place and its view.
    """
    spots = (
        newest_surveys.groupBy("sensor_ID")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("lng", "lat")).alias("spot"))
        .where("n = 1")
        .select("sensor_ID", F.col("spot.lng").alias("spot_lng"), F.col("spot.lat").alias("spot_lat"))
    )
    views = views.select(
        F.col("place").alias("location"),
        F.col("lng").alias("view_lng"),
        F.col("lat").alias("view_lat"),
        F.col("zoom").alias("view_zoom"),
    )
    by_sensor = F.col("sensor_ID").isNotNull()
    found = F.col("spot_found")
    return (
        links.join(settle(spots, "spots").withColumn("spot_found", F.lit(True)), "sensor_ID", "left")
        .join(settle(views, "views"), "location", "left")
        .select(
            "link_id",
            F.when(by_sensor, F.col("spot_lng")).otherwise(F.col("view_lng")).alias("lng"),
            F.when(by_sensor, F.col("spot_lat")).otherwise(F.col("view_lat")).alias("lat"),
            F.when(by_sensor, F.when(found, SENSOR_ZOOM)).otherwise(F.col("view_zoom")).alias("zoom"),
            F.when(~by_sensor, F.col("location")).alias("place"),
        )
    )
