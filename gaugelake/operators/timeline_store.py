"""The status timeline as a table that days are appended to.

Intervals that a later reading can still cut are those of a sensor's last instant. They are not
stored; the last instants are. Appending a day computes the intervals of its readings and of the
instants the day before left behind, and stores those that are now settled in the day's own folder:
the seam to earlier days lies in the new folder, so no old one is written again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.operators.instants import with_next
from gaugelake.operators.timeline import opened_instants, stretches
from gaugelake.schemas import CURRENT_MINUTES, DOWN_MINUTES
from gaugelake.settle import settle
from gaugelake.sources.warehouse import DAY

LAST = "sensor_ID STRING, date TIMESTAMP, pairs ARRAY<STRUCT<alert: BOOLEAN, road: BOOLEAN>>"
INTERVALS = "sensor_ID STRING, from_ts TIMESTAMP, to_ts TIMESTAMP, flood_status STRING"


class TimelineStore:
    """The timeline below ``root``: ``intervals`` and ``last``, each by day."""

    def __init__(self, spark: SparkSession, root: str, current_min=CURRENT_MINUTES, down_min=DOWN_MINUTES):
        self.spark, self.root = spark, root
        self.limits = current_min, down_min

    def days(self) -> list[str]:
        """The days appended, ascending. A day counts once its last instants are written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = path(f"{self.root}/last")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        done = [n for n in names if files.exists(path(f"{self.root}/last/{n}/_SUCCESS"))]
        return sorted(n.removeprefix(f"{DAY}=") for n in done)

    def _last(self, day: str | None) -> DataFrame:
        if day is None:
            return self.spark.createDataFrame([], LAST)
        return self.spark.read.schema(LAST).parquet(f"{self.root}/last/{DAY}={day}")

    def append(self, readings: DataFrame, day: str) -> None:
        """Append the readings of a day (``yyyy-MM-dd``), all newer than those of earlier days.

        ``day`` names the folder; a first delivery may hold a longer stretch that ends there. The
        newest day may be appended again and replaces itself. After a change of an older day, that
        day and all later ones are appended again, in order.
        """
        earlier = [d for d in self.days() if d < day]
        before = self._last(earlier[-1] if earlier else None)
        both = before.unionByName(opened_instants(readings).select(*before.columns))
        rows = settle(with_next(both, "sensor_ID", "date"), "instants")
        settled = stretches(rows.where("next_ts IS NOT NULL"), *self.limits)
        settled.write.mode("overwrite").parquet(f"{self.root}/intervals/{DAY}={day}")
        last = rows.where("next_ts IS NULL").select(*before.columns)
        last.write.mode("overwrite").parquet(f"{self.root}/last/{DAY}={day}")

    def read(self) -> DataFrame:
        """The whole timeline, as ``status_timeline`` over all readings appended."""
        days = self.days()
        if not days:
            return self.spark.createDataFrame([], INTERVALS)
        stored = self.spark.read.schema(f"{INTERVALS}, {DAY} STRING").parquet(f"{self.root}/intervals")
        stored = stored.where(F.col(DAY) <= days[-1]).drop(DAY)
        end = F.lit(None).cast("timestamp").alias("next_ts")
        still = stretches(self._last(days[-1]).select("*", end), *self.limits)
        return stored.unionByName(still)
