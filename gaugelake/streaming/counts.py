"""How many different readings of each sensor have come, whatever is delivered twice.

Repeats are dropped by a stateful operator that remembers rows until the watermark has passed them;
what is older is dropped as late, so a file that comes again changes nothing. The rows that are left
are counted batch by batch and added to a versioned table: a batch that is replayed adds to
the version before its own, not to the one it wrote.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugelake.streaming.snapshot import FIRST, remove_below, version, versions

SCHEMA = "sensor_ID STRING, n BIGINT, first_ts TIMESTAMP, last_ts TIMESTAMP"


def counted(readings: DataFrame) -> DataFrame:
    """Readings of each sensor, and the first and last instant; the same for batches and tables."""
    return readings.groupBy("sensor_ID").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_ts"), F.max("date").alias("last_ts")
    )


def _added(kept: DataFrame, more: DataFrame) -> DataFrame:
    return kept.unionByName(more).groupBy("sensor_ID").agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The newest committed version; empty before the first batch."""
    found = versions(spark, folder)
    schema = spark.createDataFrame([], SCHEMA).schema
    return version(spark, folder, schema, found[-1]) if found else spark.createDataFrame([], schema)


def maintain_counts(
    readings: DataFrame, folder: str, checkpoint: str, late_by: str = "1 day", **trigger
) -> StreamingQuery:
    """Start the stream. A repeat is a row equal in all columns that comes within ``late_by``."""
    spark = readings.sparkSession
    schema = spark.createDataFrame([], SCHEMA).schema
    if not versions(spark, folder):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch={FIRST}")

    def add(changed: DataFrame, batch: int) -> None:
        session = changed.sparkSession
        base = max(v for v in versions(session, folder) if v < batch)
        merged = _added(version(session, folder, schema, base), counted(changed))
        merged.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        remove_below(session, folder, below=base)

    return (
        readings.withWatermark("date", late_by)
        .dropDuplicatesWithinWatermark()
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(add)
        .trigger(**trigger)
        .start()
    )
