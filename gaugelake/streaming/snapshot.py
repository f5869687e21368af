"""The newest reading per sensor, kept up to date by a stream.

The stream keeps one row of state per sensor, so it needs no watermark to stay small; a late
or repeated row cannot win over a newer one. Of tied readings it keeps the one with the
largest other columns. Each batch writes a new version of the snapshot and never changes an
old one: a batch that is replayed after a failure writes its own version again. A version counts
once it is committed (its folder holds ``_SUCCESS``); a batch reads the one before, removes all
that are older, and so costs the same however long the stream has run.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def newest_per_sensor(readings: DataFrame) -> DataFrame:
    """One newest reading per sensor; the same code for streams and for tables."""
    rest = [c for c in readings.columns if c not in ("sensor_ID", "date")]
    row = F.struct("date", *rest)
    return (
        readings.groupBy("sensor_ID")
        .agg(F.max(row).alias("row"))
        .select("sensor_ID", "row.*")
        .select(*readings.columns)
    )


#: Number of the empty version that a stream begins with.
FIRST = -1


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [status.getPath().getName() for status in files.listStatus(root)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(
        int(name.removeprefix("batch="))
        for name in names
        if name.startswith("batch=") and files.exists(path(f"{folder}/{name}/_SUCCESS"))
    )


def version(spark: SparkSession, folder: str, schema: StructType, number: int) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/batch={number}")


def read_snapshot(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The newest committed version; empty before the first batch.

    It stays readable until two more batches have been committed.
    """
    found = versions(spark, folder)
    return version(spark, folder, schema, found[-1]) if found else spark.createDataFrame([], schema)


def remove_below(spark: SparkSession, folder: str, below: int) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for number in versions(spark, folder):
        if number < below:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={number}"), True)


def maintain_snapshot(
    readings: DataFrame, folder: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start the stream. ``trigger`` is that of ``DataStreamWriter.trigger``."""
    schema = readings.schema
    spark = readings.sparkSession
    if not versions(spark, folder):  # a first version to build on
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch={FIRST}")

    def upsert(changed: DataFrame, batch: int) -> None:
        session = changed.sparkSession
        base = max(v for v in versions(session, folder) if v < batch)
        kept = version(session, folder, schema, base)
        merged = newest_per_sensor(kept.unionByName(changed))
        merged.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        remove_below(session, folder, below=base)

    return (
        newest_per_sensor(readings)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(upsert)
        .trigger(**trigger)
        .start()
    )
