"""Previous and next instants of a key without sorting whole keys.

A window over a sensor's full history would sort it in one task. Here time is cut into
buckets: rows are ordered only inside (key, bucket), and what a row needs from beyond its
bucket comes from a summary with one row per key and bucket, whose size follows the length
of the record, not the number of readings. The input has one row per key and instant, so
copies of a reading have been merged before any row is moved for ordering.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 3600


def bucket_of(ts: str, seconds: int = BUCKET_SECONDS) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)


def with_next(instants: DataFrame, key: str, ts: str, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Add ``next_ts``, the key's following instant, NULL for its last."""
    rows = instants.withColumn("bucket", bucket_of(ts, seconds))
    inside = Window.partitionBy(key, "bucket").orderBy(ts)
    across = Window.partitionBy(key).orderBy("bucket")
    edges = (
        rows.groupBy(key, "bucket")
        .agg(F.min(ts).alias("first_ts"))
        .select(key, "bucket", F.lead("first_ts").over(across).alias("beyond"))
    )
    return (
        rows.withColumn("next_ts", F.lead(ts).over(inside))
        .join(edges, [key, "bucket"])
        .withColumn("next_ts", F.coalesce("next_ts", "beyond"))
        .drop("bucket", "beyond")
    )
