"""Third-party water levels beside the sensors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.clock import day, utc_midnight
from gaugelake.functions.text import filled, has_item
from gaugelake.settle import settle
from gaugelake.sources.payloads import asked_between, tide_rows
from gaugelake.sources.warehouse import on_days, water_levels

TYPE_SEPARATOR = ", "


def shown_by_default() -> Column:
    """Overlays start switched on where the sensor id contains this site code."""
    return F.col("sensor_ID").contains("CB_")


def overlay_meta(newest_surveys: DataFrame) -> DataFrame:
    """Which overlays each sensor can show, from its newest survey rows."""
    primary = F.split("wl_types", TYPE_SEPARATOR)
    alternate = F.split("alt_wl_types", TYPE_SEPARATOR)
    return newest_surveys.select(
        "sensor_ID",
        "wl_id",
        "wl_src",
        "wl_url",
        "alt_wl_id",
        "alt_wl_src",
        "alt_wl_url",
        F.col("wl_url").isNotNull().alias("primary_ok"),
        filled(F.col("alt_wl_url")).alias("alt_ok"),
        shown_by_default().alias("default_on"),
        has_item(primary, "obs").alias("has_obs"),
        has_item(primary, "pred").alias("has_pred"),
        has_item(alternate, "obs").alias("alt_has_obs"),
    )


def _days(start, end) -> tuple[Column, Column]:
    """The two days of a range in order, whichever way round they were given."""
    return F.least(day(start), day(end)), F.greatest(day(start), day(end))


def provider_observations(provider: DataFrame, start, end) -> DataFrame:
    """Water levels of the stored providers, ``start`` to ``end`` midnight inclusive (UTC)."""
    first, last = _days(start, end)
    inside = F.col("date").between(utc_midnight(first), utc_midnight(last))
    return (
        water_levels(on_days(provider, first, last))
        .where(inside)
        .select(
            "id",
            "date",
            F.col("value").alias("level"),
            F.col("api_name").alias("entity"),
            F.lit("observation").alias("notes"),
        )
    )


def tide_levels(payloads: DataFrame, start, end) -> DataFrame:
    """Tide-service rows of whole days; the service's last day is inclusive.

    Answers to requests for other days are left out before they are parsed.
    """
    first, last = _days(start, end)
    date, after = F.col("date"), utc_midnight(F.date_add(last, 1))
    rows = tide_rows(asked_between(payloads, first, last), "obs", "pred")
    return rows.where((date >= utc_midnight(first)) & (date < after))


def dispatched(gauges: DataFrame, provider: DataFrame, payloads: DataFrame, start, end) -> DataFrame:
    """Rows of each gauge reference from the source its ``src`` names, in any case.

    ``gauges`` has ``id``, ``src``, ``want`` (``obs`` or ``pred``) and anything to carry along.
    Stored providers know observations only and return them whatever is wanted; unknown sources
    return nothing. Each source is read once for all gauges. ``gauges`` should be settled: it is
    then broadcast if it fits, so that the readings of a gauge shared by many sensors stay where
    they were read.
    """
    src = F.upper("src")
    noaa = gauges.where(src == "NOAA")
    wanted = noaa.select("id", F.col("want").alias("type")).distinct()
    asked = payloads.join(wanted, ["id", "type"], "left_semi")  # before parsing
    tide = tide_levels(asked, start, end).withColumnRenamed("type", "want").join(noaa, ["id", "want"])
    stored = provider_observations(provider, start, end).join(
        gauges.where(src.isin("FIMAN", "HOHONU")), "id"
    )
    return tide.unionByName(stored)


def overlay_series(
    meta: DataFrame,
    constants: DataFrame,
    provider: DataFrame,
    payloads: DataFrame,
    start,
    end,
    *kinds: str,
) -> DataFrame:
    """Overlay levels in both datums for every sensor that may show them, with their ``kind``.

    Kinds are ``obs``, ``pred`` and ``alt`` (observations of the alternate gauge); all of them
    are found in one pass over the sources.
    """
    primary = F.col("primary_ok") | F.col("default_on")
    usable = {
        "obs": F.col("has_obs") & primary,
        "pred": F.col("has_pred") & primary,
        "alt": F.col("alt_has_obs") & F.col("alt_ok"),
    }
    shown = [
        F.when(
            usable[kind],
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit("pred" if kind == "pred" else "obs").alias("want"),
                F.col("alt_wl_id" if kind == "alt" else "wl_id").alias("id"),
                F.col("alt_wl_src" if kind == "alt" else "wl_src").alias("src"),
            ),
        )
        for kind in kinds
    ]
    gauges = (
        meta.select("sensor_ID", F.explode(F.array_compact(F.array(*shown))).alias("g"))
        .select("sensor_ID", "g.*")
        .distinct()
        .join(constants.select("sensor_ID", "road_elevation"), "sensor_ID")
    )
    rows = dispatched(settle(gauges, "gauges"), provider, payloads, start, end)
    return rows.select(
        "sensor_ID",
        "kind",
        "date",
        (F.col("level") - F.col("road_elevation")).alias("road_water_level"),
        F.col("level").alias("sensor_water_level"),
        "entity",
        "notes",
    )
