"""Flood-status changes as they happen, also those caused by silence.

A status can change without any new row: 41 minutes after the last reading the sensor
counts as silent and after 180 minutes as down. Event-time timers raise these changes.

The stream first gathers each sensor's readings by minute, as a set of instants and statuses.
This is an ordinary windowed aggregation, in which copies of a reading meet before the shuffle.
Of a minute's set only those readings go on that can change the status, and those of its newest
instant: a sensor cannot fall silent within a minute, so nothing else is needed and nothing is
lost. Windows close at the watermark, hence the changes do not depend on how rows fall into
batches.

Readings of one instant may lead to different statuses; all of them hold then, as they do in
``status_timeline``. A change is a status that begins to hold.
"""

import json
import sys
from contextlib import contextmanager
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugelake.operators.status import above_alert, above_road, current_status, silent_status
from gaugelake.schemas import CURRENT_MINUTES, DOWN_MINUTES

# Ship the processor itself, so that executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "sensor_ID STRING, at_us BIGINT, flood_status STRING"
STATE = "last_us BIGINT, silent STRING, told STRING, told_us BIGINT"
MINUTE_US = 60_000_000


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within it, streams that start keep their state in RocksDB; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(
        name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _text(value):
    return None if pd.isna(value) else value


def _packed(statuses) -> str:
    """A set of statuses as text; a missing status is a status of its own."""
    return json.dumps(sorted(set(statuses), key=str))


class _StatusChanges(StatefulProcessor):
    """Holds the newest instant and its silent statuses, the statuses last reported and the
    moment up to which changes have been considered."""

    def __init__(self, current_min: int, down_min: int):
        self.silent_us = (current_min + 1) * MINUTE_US
        self.down_us = down_min * MINUTE_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", STATE)

    def _silences(self, last_us, silent):
        """When silence after an instant changes the statuses, and to what."""
        if self.silent_us < self.down_us:
            yield last_us + self.silent_us, silent
        yield last_us + self.down_us, ["UNKNOWN"]

    def _tell(self, events, told, changes):
        """Append the statuses that begin with each event; returns those after the last."""
        for at_us, statuses in events:
            changes += [(at_us, s) for s in statuses if s not in told]
            told = statuses
        return told

    def _as_frame(self, key, changes):
        if changes:
            at, statuses = zip(*changes)
            yield pd.DataFrame(
                {
                    "sensor_ID": key[0],
                    "at_us": list(at),
                    "flood_status": pd.Series(list(statuses), dtype=object),
                }
            )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows)).drop_duplicates().sort_values("at_us")
        last_us, silent, told, told_us = None, [], [], None
        if self.newest.exists():
            last_us, silent, told, told_us = self.newest.get()
            silent, told = json.loads(silent), json.loads(told)
        changes = []
        for at_us, tied in samples.groupby("at_us", sort=True):
            at_us, events = int(at_us), []
            if last_us is not None:
                events = [e for e in self._silences(last_us, silent) if told_us < e[0] < at_us]
            events.append((at_us, json.loads(_packed(map(_text, tied["current"])))))
            told = self._tell(events, told, changes)
            silent = json.loads(_packed(map(_text, tied["silent"])))
            last_us, told_us = at_us, at_us
        self.newest.update((last_us, _packed(silent), _packed(told), told_us))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for due_us, _ in self._silences(last_us, silent):
            # The end of the minute: by then every sample before the due moment has come.
            self.handle.registerTimer((due_us // MINUTE_US + 1) * (MINUTE_US // 1000))
        yield from self._as_frame(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.newest.exists():
            return
        last_us, silent, told, told_us = self.newest.get()
        silent, told = json.loads(silent), json.loads(told)
        now_us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        events = [e for e in self._silences(last_us, silent) if told_us < e[0] < now_us]
        changes = []
        told = self._tell(events, told, changes)
        told_us = max([told_us, *(due for due, _ in events)])
        self.newest.update((last_us, _packed(silent), _packed(told), told_us))
        yield from self._as_frame(key, changes)

    def close(self) -> None:
        pass


def telling_samples(readings: DataFrame, late_by: str) -> DataFrame:
    """The readings of each sensor and minute that can change its status, and its newest ones.

    A reading goes on if its status differs from the one before, if it or the one before is tied
    with another, and if it is of the minute's first or last instant.
    """
    facts = readings.withWatermark("date", late_by).select(
        "sensor_ID",
        "date",
        F.unix_micros("date").alias("at_us"),
        current_status(above_alert(), above_road()).alias("current"),
        silent_status(above_alert(), above_road()).alias("silent"),
    )
    minutes = (
        facts.groupBy(F.window("date", "1 minute"), "sensor_ID")
        .agg(F.collect_set(F.struct("at_us", "current", "silent")).alias("found"))
        .select(
            "sensor_ID",
            F.window_time("window").alias("minute"),
            F.array_sort("found").alias("found"),
        )
    )
    size = F.size("found")

    def at(index: Column) -> Column:
        return F.get(F.col("found"), index)

    def telling(reading: Column, index: Column) -> Column:
        before, after, earlier = at(index - 1), at(index + 1), at(index - 2)
        same = reading["current"].eqNullSafe(before["current"])
        tied = F.coalesce(reading["at_us"] == before["at_us"], F.lit(False))
        tied = tied | F.coalesce(reading["at_us"] == after["at_us"], F.lit(False))
        tied = tied | F.coalesce(before["at_us"] == earlier["at_us"], F.lit(False))
        last = reading["at_us"] == at(size - 1)["at_us"]
        return ~same | tied | last | (index == 0)

    kept = minutes.withColumn("found", F.filter("found", telling))
    # Not inferring a filter on the list's size keeps the list from being built twice.
    rows = kept.select("sensor_ID", "minute", F.explode_outer("found").alias("r"))
    return rows.select("sensor_ID", "minute", "r.at_us", "r.current", "r.silent")


def status_changes(
    readings: DataFrame,
    late_by: str = "10 minutes",
    current_min: int = CURRENT_MINUTES,
    down_min: int = DOWN_MINUTES,
) -> DataFrame:
    """Stream of ``sensor_ID, at, flood_status``: each status as it begins, up to the watermark.

    Readings behind the watermark are dropped. Needs the RocksDB state
    store: start it within ``state_store``.
    """
    changes = (
        telling_samples(readings, late_by)
        .groupBy("sensor_ID")
        .transformWithStateInPandas(
            statefulProcessor=_StatusChanges(current_min, down_min),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return changes.select("sensor_ID", F.timestamp_micros("at_us").alias("at"), "flood_status")
