"""Flood-status changes as a log that batches of a stream extend, without Python on the rows.

Each batch is worked off by the expressions of the timeline: its readings, the readings not yet
closed and the last instant of every sensor give intervals, whose beginnings are the changes.
Instants are ordered inside hours of a sensor and hours meet through one row each, so a first batch
that holds a sensor's history of years is spread over tasks like any other table. What a batch
leaves behind is a small table: the last instant of each sensor, and readings newer than the
watermark. It is written as a version of its own, as the snapshot's are; a batch that is replayed
writes the same changes and the same version again.

The watermark is the newest reading of all less ``late_by``, cut to the minute. Changes are told up
to it, also those that silence brings; readings behind it are dropped.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugelake.functions.clock import instant
from gaugelake.operators.instants import with_next
from gaugelake.operators.status import above_alert, above_road
from gaugelake.operators.timeline import statuses_begun, stretches
from gaugelake.schemas import CURRENT_MINUTES, DOWN_MINUTES
from gaugelake.settle import settle
from gaugelake.streaming.snapshot import FIRST, remove_below, versions

#: Open instants: one row for each sensor, moment and pair of comparisons. ``told`` is the moment up
#: to which changes are in the log.
STATE = "sensor_ID STRING, date TIMESTAMP, alert BOOLEAN, road BOOLEAN, told TIMESTAMP"
CHANGES = "sensor_ID STRING, at TIMESTAMP, flood_status STRING"


def _facts(readings: DataFrame) -> DataFrame:
    """What the status depends on; copies meet before the shuffle."""
    facts = readings.where("sensor_ID IS NOT NULL AND date IS NOT NULL").select(
        "sensor_ID", "date", above_alert().alias("alert"), above_road().alias("road")
    )
    return facts.distinct()


def _instants(facts: DataFrame) -> DataFrame:
    pairs = F.collect_set(F.struct("alert", "road")).alias("pairs")
    return facts.groupBy("sensor_ID", "date").agg(pairs)


def _last(facts: DataFrame) -> DataFrame:
    """The facts of each sensor's last instant."""
    newest = facts.groupBy("sensor_ID").agg(F.max("date").alias("date"))
    return facts.join(newest, ["sensor_ID", "date"])


def _minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


class ChangeLog:
    """The log below ``folder``: ``state`` by versions, ``changes`` by batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.state, self.changes = spark, f"{folder}/state", f"{folder}/changes"

    def _write_state(self, facts: DataFrame, number: int) -> None:
        facts.coalesce(8).write.mode("overwrite").parquet(f"{self.state}/batch={number}")

    def _state(self, number: int) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.state}/batch={number}")

    def begin(self, history: DataFrame | None = None, since=None) -> None:
        """Lay the ground for a stream, empty or from what ``history`` says before ``since``.

        The stream then tells what a stream over history and rows since would tell from ``since``
        on. A log that exists already is left as it is.
        """
        if versions(self.spark, self.state):
            return
        facts = self.spark.createDataFrame([], STATE)
        if history is not None:
            begin = instant(since)
            before = _last(settle(_facts(history.where(F.col("date") < begin)), "history"))
            facts = before.withColumn("told", begin)
        self._write_state(facts, FIRST)

    def extend(self, readings: DataFrame, batch: int, late_by: str, current_min: int, down_min: int) -> None:
        """Work off one batch of readings."""
        base = max(v for v in versions(self.spark, self.state) if v < batch)
        state = self._state(base)
        told = state.agg(F.max("told")).first()[0]
        fresh = _facts(readings)
        if told is not None:
            fresh = fresh.where(F.col("date") >= F.lit(told))
        facts = settle(state.drop("told").unionByName(fresh).distinct(), "facts")
        newest = facts.agg(F.max("date").alias("date")).select(
            F.greatest(_minute(F.col("date") - F.expr(f"INTERVAL {late_by}")), F.lit(told).cast("timestamp"))
        )
        mark = newest.first()[0]
        if mark is None:  # neither state nor readings
            return
        closed = facts.where(F.col("date") < F.lit(mark))
        intervals = stretches(with_next(_instants(closed), "sensor_ID", "date"), current_min, down_min)
        begun = statuses_begun(settle(intervals, "intervals")).where(F.col("at") < F.lit(mark))
        if told is not None:
            begun = begun.where(F.col("at") >= F.lit(told))
        begun.write.mode("overwrite").parquet(f"{self.changes}/batch={batch}")
        kept = _last(closed).unionByName(facts.where(F.col("date") >= F.lit(mark)))
        self._write_state(kept.withColumn("told", F.lit(mark)).select(*(f.split(" ")[0] for f in STATE.split(", "))), batch)
        remove_below(self.spark, self.state, below=base)

    def read(self) -> DataFrame:
        """The changes of all committed batches."""
        newest = max(versions(self.spark, self.state), default=FIRST)
        if not versions(self.spark, self.changes):
            return self.spark.createDataFrame([], CHANGES)
        found = self.spark.read.schema(f"{CHANGES}, batch BIGINT").parquet(self.changes)
        return found.where(F.col("batch") <= newest).drop("batch")


def maintain_changes(
    readings: DataFrame,
    folder: str,
    checkpoint: str,
    late_by: str = "10 minutes",
    current_min: int = CURRENT_MINUTES,
    down_min: int = DOWN_MINUTES,
    **trigger,
) -> StreamingQuery:
    """Start a stream of readings that extends the log; ``trigger`` as in ``DataStreamWriter``."""
    ChangeLog(readings.sparkSession, folder).begin()

    def work(changed: DataFrame, batch: int) -> None:
        log = ChangeLog(changed.sparkSession, folder)
        log.extend(changed, batch, late_by, current_min, down_min)

    return (
        readings.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(work)
        .trigger(**trigger)
        .start()
    )
