"""The sensor time series and the quantities drawn around it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.clock import day, epoch_ms, instant, local_midnight
from gaugelake.operators.latest import one_per_key
from gaugelake.schemas import DRY_BAND_FT, MAX_OVERLAY_DAYS, MAX_REQUEST_READINGS, READINGS_PER_DAY
from gaugelake.sources.warehouse import on_days

ROAD, NAVD88 = "Road", "NAVD88"

# Wording of the reference line.
DRAIN_LABEL, LAND_LABEL = "Bottom of Drain", "Land Elevation"


def default_range(as_of) -> tuple[Column, Column]:
    """First and last local day of a new chart: two days back to tomorrow."""
    today = instant(as_of).cast("date")
    return F.date_sub(today, 2), F.date_add(today, 1)


def sensor_series(readings: DataFrame, start, end, sensor_ids=None) -> DataFrame:
    """Readings that passed quality control in ``[start, end)``, both local days.

    ``sensor_ids`` is a list, or a DataFrame with ``sensor_ID`` for long selections.
    """
    date = F.col("date")
    inside = (date >= local_midnight(start)) & (date < local_midnight(end))
    kept = on_days(readings, day(start), day(end)).where(inside & (F.col("qa_qc_flag") == F.lit(False)))
    if sensor_ids is None:
        return kept
    if isinstance(sensor_ids, DataFrame):
        return kept.join(sensor_ids.select("sensor_ID"), "sensor_ID", "left_semi")
    return kept.where(F.col("sensor_ID").isin(list(sensor_ids)))


def request_guard(requests: DataFrame) -> DataFrame:
    """Which date ranges may be charted, and which with overlays.

    ``requests`` has ``request_id``, ``first_day``, ``last_day`` and ``admin``.
    """
    days = F.datediff("last_day", "first_day")
    fits = days * READINGS_PER_DAY <= MAX_REQUEST_READINGS
    return requests.select(
        "request_id",
        days.alias("days"),
        (fits | F.col("admin")).alias("allowed"),
        (F.abs(days) <= MAX_OVERLAY_DAYS).alias("overlay_allowed"),
    )


def sensor_constants(sensors: DataFrame) -> DataFrame:
    """One row of elevations per sensor of the map table."""
    return one_per_key(
        sensors.select("sensor_ID", "sensor_elevation", "road_elevation"), ["sensor_ID"]
    )


def stacked(df: DataFrame, keep: list, rows: list[Column]) -> DataFrame:
    """Turn each row into several, one per struct, in the same pass over the data."""
    return df.select(*keep, F.inline(F.array(*rows)))


def _limits(df: DataFrame, constants: DataFrame) -> DataFrame:
    """Join the sensors' elevations as ``sensor_limit`` and ``road_limit`` (NAVD88)."""
    limits = constants.select(
        "sensor_ID",
        F.col("sensor_elevation").alias("sensor_limit"),
        F.col("road_elevation").alias("road_limit"),
    )
    return df.join(limits, "sensor_ID", "left")


def unless_dry(level: Column, sensor_limit: Column) -> Column:
    """NULL within the band in which a dry sensor reads its own elevation."""
    dry = (level < sensor_limit + F.lit(DRY_BAND_FT)) & (level > sensor_limit - F.lit(DRY_BAND_FT))
    return F.when(dry, F.lit(None).cast("double")).otherwise(level)


def _water_level_rows() -> list[Column]:
    """The blanked level in either datum, for a series joined with its limits."""
    above_datum = {
        ROAD: (F.col("road_water_level_adj"), F.col("sensor_limit") - F.col("road_limit")),
        NAVD88: (F.col("sensor_water_level_adj"), F.col("sensor_limit")),
    }
    return [
        F.struct(F.lit(datum).alias("datum"), unless_dry(level, limit).alias("wl"))
        for datum, (level, limit) in above_datum.items()
    ]


def blank_dry(series: DataFrame, constants: DataFrame, datum: str | None = None) -> DataFrame:
    """Levels as ``wl`` with dry readings blanked, in both datums or one."""
    rows = _water_level_rows()
    if datum is not None:
        rows = [rows[[ROAD, NAVD88].index(datum)]]
    return stacked(_limits(series, constants), ["sensor_ID", "date"], rows)


def axis_bounds(
    series: DataFrame, constants: DataFrame, references: DataFrame, overlay: bool = False
) -> DataFrame:
    """Vertical axis bounds per sensor and datum, from the levels before blanking.

    The lower bound compares NAVD88 levels in both datums. It is left open with overlays.
    """
    extremes = series.groupBy("sensor_ID").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("road_water_level_adj").alias("top_road"),
        F.max("sensor_water_level_adj").alias("top_navd"),
        F.min("sensor_water_level_adj").alias("low"),
    )
    joined = constants.join(references, "sensor_ID", "left").join(extremes, "sensor_ID", "left")
    road = F.col("road_elevation")
    low = F.col("low")
    drawn = F.coalesce("n", F.lit(0)) > 0

    def bounds(datum: str, top: Column, road_limit: Column, zero: Column) -> Column:
        ref = F.col("reference_elevation") - zero
        y_max = F.when(
            drawn & road_limit.isNotNull(), F.when(top > road_limit, top).otherwise(road_limit + 0.25)
        )
        with_ref = F.when(drawn, F.when(low < ref, low).otherwise(ref - 0.25))
        y_min = F.when(ref.isNotNull(), with_ref).otherwise(F.col("sensor_elevation") - zero - 1)
        if overlay:
            y_min = F.lit(None).cast("double")
        return F.struct(F.lit(datum).alias("datum"), y_min.alias("y_min"), y_max.alias("y_max"))

    return stacked(
        joined,
        ["sensor_ID"],
        [
            bounds(ROAD, F.col("top_road"), F.when(road.isNotNull(), 0.0), road),
            bounds(NAVD88, F.col("top_navd"), road, F.lit(0.0)),
        ],
    )


def reference_lines(constants: DataFrame, references: DataFrame, as_of) -> DataFrame:
    """Horizontal lines per sensor and datum, and the vertical line at ``as_of``."""
    kind = F.col("reference_elevation_type")
    label = F.when(kind == "drain_bottom", DRAIN_LABEL).when(kind.isNotNull(), LAND_LABEL)

    def lines(datum: str, zero: Column) -> Column:
        return F.struct(
            F.lit(datum).alias("datum"),
            (F.col("road_elevation") - zero).alias("road"),
            (F.col("sensor_elevation") - zero).alias("sensor"),
            (F.col("reference_elevation") - zero).alias("reference"),
            label.alias("reference_label"),
            epoch_ms(instant(as_of)).alias("now_ms"),
        )

    joined = constants.join(references, "sensor_ID", "left")
    return stacked(
        joined, ["sensor_ID"], [lines(ROAD, F.col("road_elevation")), lines(NAVD88, F.lit(0.0))]
    )


def no_data(sensors: DataFrame, series: DataFrame, overlay_on: Column) -> DataFrame:
    """Sensors without a reading in range get a notice unless their overlay is on."""
    counts = series.groupBy("sensor_ID").agg(F.count(F.lit(1)).alias("n"))
    return (
        sensors.select("sensor_ID")
        .distinct()
        .join(counts, "sensor_ID", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("no_data", (F.col("n") == 0) & ~overlay_on)
    )


def chart_series(
    series: DataFrame, constants: DataFrame, overlays: list[DataFrame], admin: bool = False
) -> DataFrame:
    """All plotted points in long form: ``sensor_ID, datum, series, epoch_ms, wl``.

    One pass over the readings yields both datums and, for administrators, the unadjusted
    level and a tenth of the battery voltage.
    """
    rows = [F.struct(r["datum"], F.lit("Water Level").alias("series"), r["wl"]) for r in _water_level_rows()]
    if admin:
        for datum, level in ((ROAD, "road_water_level"), (NAVD88, "sensor_water_level")):
            for name, value in (
                ("Water Level (unadjusted)", F.col(level)),
                ("Battery (Voltage/10)", F.col("voltage") / 10),
            ):
                rows.append(
                    F.struct(F.lit(datum).alias("datum"), F.lit(name).alias("series"), value.alias("wl"))
                )
    keep = ["sensor_ID", epoch_ms("date").alias("epoch_ms")]
    points = stacked(_limits(series, constants), keep, rows)
    for overlay in overlays:
        both = [
            F.struct(
                F.lit(datum).alias("datum"), F.col("entity").alias("series"), F.col(level).alias("wl")
            )
            for datum, level in ((ROAD, "road_water_level"), (NAVD88, "sensor_water_level"))
        ]
        points = points.unionByName(stacked(overlay, keep, both))
    return points.select("sensor_ID", "datum", "series", "epoch_ms", "wl")


def chart_bounds(start, end) -> tuple[Column, Column]:
    """Horizontal axis bounds in epoch milliseconds."""
    return epoch_ms(local_midnight(day(start))), epoch_ms(local_midnight(day(end)))
