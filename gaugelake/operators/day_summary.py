"""Each sensor's newest instants of each day, kept beside day folders.

Newest rows need the newest instant of every sensor, and a sensor may have fallen silent years
ago, so a search has to see the whole history. The summary has at most ``KEPT`` rows for each
sensor and day, and only the days that a delivery touched are summarised again. A search reads the
summary and then the days of the instants it found; no other day of the readings is opened.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugelake.operators import status
from gaugelake.operators.latest import rows_at
from gaugelake.sources import days
from gaugelake.sources.warehouse import DAY, TABLES

#: Newest instants kept of a day: enough for ranks up to three.
KEPT = 3
SCHEMA = f"sensor_ID STRING, date TIMESTAMP, n BIGINT, {DAY} DATE"


def _folder(root: str) -> str:
    return f"{root}/{TABLES['readings'].name}_newest"


def summarised(readings: DataFrame) -> DataFrame:
    """The newest instants of each sensor and day, and how many readings share each.

    Copies are counted before the shuffle. Instants are numbered within a sensor and day.
    """
    instants = readings.groupBy("sensor_ID", DAY, "date").agg(F.count(F.lit(1)).alias("n"))
    newest = F.row_number().over(Window.partitionBy("sensor_ID", DAY).orderBy(F.desc("date")))
    kept = instants.withColumn("nth", newest).where(F.col("nth") <= KEPT)
    return kept.select("sensor_ID", "date", "n", DAY)


def refresh(spark: SparkSession, root: str) -> list:
    """Summarise the days that deliveries noted; returns them. Other days are not read."""
    touched, notes = days.changed(spark, root, "readings")
    if touched:
        readings = days.read_days(spark, root, "readings").where(F.col(DAY).isin(touched))
        rows = summarised(readings.select("sensor_ID", "date", DAY))
        rows = rows.repartitionByRange(DAY, "sensor_ID").sortWithinPartitions(DAY, "sensor_ID")
        writer = rows.write.partitionBy(DAY).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(_folder(root))
    days.forget(spark, notes)
    return touched


def read_summary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(_folder(root))


def newest_instants(summary: DataFrame) -> DataFrame:
    """Each sensor's newest instant."""
    return summary.groupBy("sensor_ID").agg(F.max("date").alias("date"))


def ranked_instants(summary: DataFrame, n: int = KEPT) -> DataFrame:
    """Each sensor's instants with a row of rank ``n`` or better, and the rank as ``rnk``.

    Only the newest ``n`` instants of a sensor reach the running count.
    """
    if n > KEPT:
        raise ValueError(f"the summary keeps {KEPT} instants of a day")
    order = Window.partitionBy("sensor_ID").orderBy(F.desc("date"))
    heads = summary.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    newer = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumn("rnk", (F.coalesce(newer, F.lit(0)) + 1).cast("int"))
    return heads.where(F.col("rnk") <= n).select("sensor_ID", "date", "rnk")


def _at(readings: DataFrame, instants: DataFrame) -> DataFrame:
    return rows_at(readings, instants, ["sensor_ID"], "date")


def flood_status(spark: SparkSession, root: str, as_of, **limits) -> DataFrame:
    """``status.flood_status`` over the whole history of delivered readings."""
    readings = days.read_days(spark, root, "readings")
    facts = readings.select(
        "sensor_ID", "date", "sensor_water_level_adj", "alert_threshold", "road_elevation", DAY
    )
    newest = _at(facts, newest_instants(read_summary(spark, root)))
    return status.judge(newest, as_of, **limits).select(*status.STATUS_COLUMNS)


def top_readings(spark: SparkSession, root: str, n: int = KEPT) -> DataFrame:
    """``latest.newest_ranked`` over the whole history: rows of rank 1 to ``n``, with ``rnk``."""
    readings = days.read_days(spark, root, "readings")
    return _at(readings, ranked_instants(read_summary(spark, root), n))
