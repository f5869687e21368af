"""The flood status over all past time, as intervals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.clock import instant
from gaugelake.operators.instants import BUCKET_SECONDS, with_next
from gaugelake.operators.status import above_alert, above_road, current_status, silent_status
from gaugelake.schemas import CURRENT_MINUTES, DOWN_MINUTES


def opened_instants(readings: DataFrame) -> DataFrame:
    """One row per sensor and instant with the pairs of comparisons its readings lead to.

    The status depends on a reading only through two comparisons, so an instant holds at most
    nine different pairs of them, however many readings share it.
    """
    pairs = F.collect_set(F.struct(above_alert().alias("alert"), above_road().alias("road")))
    named = readings.where("sensor_ID IS NOT NULL")
    return named.groupBy("sensor_ID", "date").agg(pairs.alias("pairs"))


def status_timeline(
    readings: DataFrame,
    current_min: int = CURRENT_MINUTES,
    down_min: int = DOWN_MINUTES,
    seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Intervals ``[from_ts, to_ts)`` of each status; ``to_ts`` is NULL while open.

    A reading opens a current, a silent and a down stretch, cut at the next reading. At any
    moment the intervals give the status computed from the readings up to that moment.
    """
    instants = with_next(opened_instants(readings), "sensor_ID", "date", seconds)
    return stretches(instants, current_min, down_min)


def stretches(
    instants: DataFrame, current_min: int = CURRENT_MINUTES, down_min: int = DOWN_MINUTES
) -> DataFrame:
    """The intervals of instants (sensor_ID, date, pairs, next_ts)."""

    def after(minutes: int) -> Column:
        return F.timestamp_micros(F.unix_micros("date") + minutes * 60_000_000)

    def stretch(begin: Column, until: Column, statuses: Column) -> Column:
        """The instant's different statuses over one stretch, as interval structs."""
        return F.transform(
            F.array_distinct(statuses),
            lambda s: F.struct(
                begin.alias("from_ts"), until.alias("until"), s.alias("flood_status")
            ),
        )

    def each(rule) -> Column:
        return F.transform("pairs", lambda pair: rule(pair["alert"], pair["road"]))

    silent_from, down_from = after(current_min + 1), after(down_min)
    parts = F.concat(
        stretch(F.col("date"), F.least(silent_from, down_from), each(current_status)),
        stretch(silent_from, down_from, each(silent_status)),
        stretch(down_from, F.lit(None).cast("timestamp"), F.array(F.lit("UNKNOWN"))),
    )
    return (
        instants.select("sensor_ID", "next_ts", F.inline(parts))
        .withColumn("to_ts", F.least("until", "next_ts"))  # least skips NULLs
        .where(F.col("to_ts").isNull() | (F.col("from_ts") < F.col("to_ts")))
        .select("sensor_ID", "from_ts", "to_ts", "flood_status")
    )


def statuses_begun(timeline: DataFrame) -> DataFrame:
    """Each status as it begins to hold: intervals that continue none of the same status.

    The join is on sensor, status and moment, so a sensor with a long record is no hot key.
    """
    before = timeline.select(
        F.col("sensor_ID").alias("_sensor"), F.col("to_ts").alias("_to"), F.col("flood_status").alias("_status")
    ).where("_to IS NOT NULL")
    same = (
        (F.col("sensor_ID") == F.col("_sensor"))
        & (F.col("from_ts") == F.col("_to"))
        & F.col("flood_status").eqNullSafe(F.col("_status"))
    )
    begun = timeline.join(before, same, "left_anti")
    return begun.select("sensor_ID", F.col("from_ts").alias("at"), "flood_status").distinct()


def status_at(timeline: DataFrame, as_of) -> DataFrame:
    """The statuses in force at a moment."""
    now = instant(as_of)
    open_then = F.col("to_ts").isNull() | (F.col("to_ts") > now)
    return timeline.where((F.col("from_ts") <= now) & open_then).select("sensor_ID", "flood_status")
