"""Instants, local calendar bounds, ages and their wording."""

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugelake.schemas import LOCAL_ZONE


def instant(moment) -> Column:
    """A moment as a TIMESTAMP column. Naive datetimes and plain strings are UTC."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, datetime):
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=timezone.utc)
        moment = moment.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(f"{moment}Z").cast("timestamp")


def day(value) -> Column:
    """A calendar date as a DATE column."""
    if isinstance(value, Column):
        return value
    text = value.isoformat() if isinstance(value, date) else value
    return F.lit(text).cast("date")


def local_midnight(value) -> Column:
    """The UTC instant at which a date starts in the network's zone."""
    return F.to_utc_timestamp(day(value).cast("timestamp"), LOCAL_ZONE)


def utc_midnight(value) -> Column:
    """The UTC instant at which a date starts in UTC."""
    return day(value).cast("timestamp")


def epoch_ms(ts) -> Column:
    return F.unix_millis(ts)


def age_minutes(as_of, ts) -> Column:
    """Whole minutes from ``ts`` to ``as_of``, floored, so negative for later instants."""
    elapsed = F.unix_micros(instant(as_of)) - F.unix_micros(ts)
    return F.floor(elapsed / F.lit(60_000_000)).cast("bigint")


def age_text(minutes: Column) -> Column:
    """Wording of an age. Hours and days are rounded half to even."""
    hours = F.bround(minutes / 60).cast("bigint")
    days = F.bround(minutes / 1440).cast("bigint")

    def words(before, number, after):
        # Fixed format: the number is set in bold.
        return F.concat(F.lit(f"{before}<strong>"), number.cast("string"), F.lit(f"</strong>{after}"))

    return (
        F.when(minutes < 60, words("", minutes, " minutes ago"))
        .when(minutes < 1440, words("about ", hours, " hour(s) ago"))
        .otherwise(words("about ", days, " day(s) ago"))
    )


def local_time(ts) -> Column:
    """A UTC instant on the network's wall clock."""
    return F.from_utc_timestamp(ts, LOCAL_ZONE)


def clock_text(ts) -> Column:
    """``07:05 PM EST - Jan 30, 2024`` on the network's wall clock.

    ``date_format`` would print the session zone, so the zone name follows from the shift.
    Missing instants read ``NA - NA``.
    """
    wall = local_time(ts)
    shift = F.unix_seconds(wall) - F.unix_seconds(ts)
    zone = F.when(shift == -4 * 3600, "EDT").otherwise("EST")
    time_of_day = F.concat(F.date_format(wall, "hh:mm a"), F.lit(" "), zone)
    calendar = F.date_format(wall, "MMM dd, yyyy")
    return F.concat(
        F.coalesce(time_of_day, F.lit("NA")), F.lit(" - "), F.coalesce(calendar, F.lit("NA"))
    )
