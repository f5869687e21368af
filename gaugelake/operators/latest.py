"""Newest rows per key, ties kept.

A key may hold a third of all rows, and a third of all rows may even be copies of its newest
row, so no key is ever gathered in one task. The newest instants are found by an
aggregation that shrinks before its shuffle and are settled as a small table; the rows are
then joined back on key and instant. When the summary fits a broadcast the join moves no
row at all, else rows spread by (key, instant). The oldest of the wanted instants also goes
into the second scan as a plain filter, which skips the row groups of older files; with day
folders, only those of wanted instants are opened.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gaugelake.functions.clock import instant
from gaugelake.settle import settle
from gaugelake.sources.warehouse import DAY, on_days


def rows_at(df: DataFrame, instants: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows of ``df`` at the given (key, instant) pairs, plus further columns of ``instants``."""
    seen = Observation()
    instants = settle(instants.observe(seen, F.min(F.unix_micros(ts)).alias("oldest")), "newest")
    oldest = seen.get["oldest"]
    if oldest is not None:
        df = df.where(F.col(ts) >= F.timestamp_micros(F.lit(oldest)))
    if DAY in df.columns:
        # At most one row for each day of the record; days may be counted in either zone.
        days = F.explode(F.array(*(F.date_add(F.col(ts).cast("date"), n) for n in (-1, 0, 1))))
        df = df.where(F.col(DAY).isin([r[0] for r in instants.select(days).distinct().collect()]))
    extra = [c for c in instants.columns if c not in (*keys, ts)]
    side = instants.select(*(F.col(c).alias(f"_{c}") for c in (*keys, ts)), *extra)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(ts) == F.col(f"_{ts}")]
    return df.join(side, reduce(lambda a, b: a & b, same)).select(*df.columns, *extra)


def newest_rows(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """All rows at each key's newest instant."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull())
    return rows_at(df, newest, keys, ts)


def newest_ranked(df: DataFrame, keys: list[str], ts: str, n: int) -> DataFrame:
    """Rows ranked 1..n by descending time within their key, with the rank as ``rnk``.

    At most ``n`` narrow rows per key and task reach the window (the row-number filter is
    applied before the shuffle). An instant's rank is the lowest row number it got.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(ts))
    heads = (
        df.where(F.col(ts).isNotNull())
        .select(*keys, ts)
        .withColumn("rnk", F.row_number().over(order))
        .where(F.col("rnk") <= n)
        .groupBy(*keys, ts)
        .agg(F.min("rnk").alias("rnk"))
    )
    return rows_at(df, heads, keys, ts)


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest by its other columns, in their order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("picked"))
    return picked.select(*keys, "picked.*").select(*df.columns)


def sample_interval(top: DataFrame) -> DataFrame:
    """Shortest time in minutes between successive readings among each sensor's newest rows.

    Tied readings lie 0 minutes apart. NULL for a sensor with a single reading. Copies are
    counted before the window, which then sees one row per sensor and instant.
    """
    newer = F.lag("date").over(Window.partitionBy("sensor_ID").orderBy(F.desc("date")))
    gap = (F.unix_micros(newer) - F.unix_micros("date")) / 60_000_000
    return (
        top.groupBy("sensor_ID", "date")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("gap", F.when(F.col("n") > 1, F.lit(0.0)).otherwise(gap))
        .groupBy("sensor_ID")
        .agg(F.min("gap").alias("min_interval"))
    )


def _since(as_of, lookback_days: int) -> Column:
    today = instant(as_of).cast("date")
    return F.col("date") > F.date_sub(today, lookback_days).cast("timestamp")


def recent_sensors(newest: DataFrame, as_of, lookback_days: int) -> DataFrame:
    """Map rows from the newest readings of all time.

    A sensor with a reading inside the lookback has its newest one there, so nothing has to
    be searched again when the newest readings are already at hand.
    """
    placed = newest.where(_since(as_of, lookback_days) & F.expr("lat IS NOT NULL AND lng IS NOT NULL"))
    return placed.withColumns(
        {
            "sensor_water_level": F.col("sensor_water_level_adj"),
            "road_water_level": F.col("road_water_level_adj"),
        }
    )


def latest_sensors(readings: DataFrame, as_of, lookback_days: int) -> DataFrame:
    """Each sensor's newest readings within the lookback that carry coordinates.

    Only the lookback is scanned.
    """
    first = F.date_sub(instant(as_of).cast("date"), lookback_days)
    recent = on_days(readings, first).where(_since(as_of, lookback_days))
    newest = newest_rows(recent, ["sensor_ID"], "date")
    return recent_sensors(newest, as_of, lookback_days)


def latest_surveys(surveys: DataFrame) -> DataFrame:
    return newest_rows(surveys, ["sensor_ID"], "date_surveyed")


def sensor_labels(newest_surveys: DataFrame) -> DataFrame:
    """One label per sensor; among tied surveys the first by name."""
    return one_per_key(newest_surveys.select("sensor_ID", "sensor_label"), ["sensor_ID"])


def reference_elevations(newest_surveys: DataFrame) -> DataFrame:
    """Distinct reference elevations of the newest surveys."""
    return newest_surveys.select(
        "sensor_ID", "reference_elevation", "reference_elevation_type"
    ).distinct()


def latest_photos(photos: DataFrame) -> DataFrame:
    return newest_rows(photos, ["camera_ID"], "DateTimeOriginalUTC")


def latest_raw(raw: DataFrame) -> DataFrame:
    """Each sensor's newest raw rows."""
    columns = raw.select("place", "sensor_ID", "voltage", "processed", "date")
    return newest_rows(columns, ["sensor_ID"], "date").withColumnRenamed("date", "raw_data_date")
