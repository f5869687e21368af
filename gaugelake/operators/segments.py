"""Where a sensor's plotted line breaks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.operators.instants import BUCKET_SECONDS, bucket_of
from gaugelake.schemas import GAP_MS
from gaugelake.settle import settle

HOT_ROWS = 1_000_000


def _breaks(date: Column, blank: Column, prev_date: Column, prev_drawn: Column, gap_ms: int) -> Column:
    """Whether the line restarts at a drawn instant, given the instant before it.

    At one instant blank readings come before drawn ones.
    """
    apart = F.unix_micros(date) - F.unix_micros(prev_date)
    return prev_date.isNull() | (apart > gap_ms * 1000) | (blank > 0) | (prev_drawn == 0)


def numbered_instants(
    series: DataFrame, gap_ms: int = GAP_MS, seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """One row per sensor and instant: ``drawn`` and ``blank`` counts and the ``segment``.

    ``series`` has ``sensor_ID``, ``date`` and ``wl``, NULL where nothing is drawn. Segments
    count from 1 per sensor; an instant with blank readings only has none. Runs are counted
    inside hourly buckets and shifted by the number of runs that start in earlier buckets.
    """
    instants = (
        series.where("sensor_ID IS NOT NULL AND date IS NOT NULL")
        .groupBy("sensor_ID", "date")
        .agg(F.count("wl").alias("drawn"), F.count(F.lit(1)).alias("n"))
        .withColumn("blank", F.col("n") - F.col("drawn"))
        .drop("n")
        .withColumn("bucket", bucket_of("date", seconds))
        # Spark infers this filter on one side of the join below; stated here it holds on
        # both, and both read the same shuffle.
        .where(F.col("bucket").isNotNull())
    )
    inside = Window.partitionBy("sensor_ID", "bucket").orderBy("date")
    prev = F.lag(F.struct("date", "drawn")).over(inside)
    rows = (
        instants.withColumn("prev", prev)
        .withColumn(
            "starts",
            F.when(
                F.col("prev").isNotNull()
                & (F.col("drawn") > 0)
                & _breaks(
                    F.col("date"), F.col("blank"), F.col("prev.date"), F.col("prev.drawn"), gap_ms
                ),
                1,
            ).otherwise(0),
        )
        .withColumn("run", F.sum("starts").over(inside))
    )

    across = Window.partitionBy("sensor_ID").orderBy("bucket")
    edges = (
        rows.groupBy("sensor_ID", "bucket")
        .agg(
            F.min(F.struct("date", "drawn", "blank")).alias("first"),
            F.max(F.struct("date", "drawn")).alias("last"),
            F.sum("starts").alias("starts"),
        )
        .withColumn("prev", F.lag("last").over(across))
        .withColumn(
            "fresh",
            F.when(
                (F.col("first.drawn") > 0)
                & _breaks(
                    F.col("first.date"),
                    F.col("first.blank"),
                    F.col("prev.date"),
                    F.col("prev.drawn"),
                    gap_ms,
                ),
                1,
            ).otherwise(0),
        )
        .withColumn("total", F.sum(F.col("starts") + F.col("fresh")).over(across))
        .select("sensor_ID", "bucket", (F.col("total") - F.col("starts")).alias("shift"))
    )
    return rows.join(edges, ["sensor_ID", "bucket"]).select(
        "sensor_ID",
        "date",
        "drawn",
        "blank",
        F.when(F.col("drawn") > 0, F.col("run") + F.col("shift")).alias("segment"),
    )


def gap_segments(
    series: DataFrame, gap_ms: int = GAP_MS, seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """The drawn runs: first and last instant and number of readings."""
    return (
        numbered_instants(series, gap_ms, seconds)
        .where(F.col("segment").isNotNull())
        .groupBy("sensor_ID", "segment")
        .agg(F.min("date").alias("start"), F.max("date").alias("end"), F.sum("drawn").alias("n"))
    )


def with_segments(
    series: DataFrame,
    gap_ms: int = GAP_MS,
    seconds: int = BUCKET_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every reading with the segment it is drawn in, NULL for blank readings.

    Readings meet their instant's number by a join on sensor and instant. Instants with more
    than ``hot_rows`` readings are split: their number is copied into so many shares that each
    stays below the bound, and their readings are dealt out over the shares. Only those instants
    are settled. The row number that deals readings out is given before any join of this
    function, so that a task that runs again gives it again.
    """
    keys = ["sensor_ID", "date"]
    shares = F.ceil(F.col("n") / F.lit(hot_rows))
    hot = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = settle(hot.select(*keys, shares.alias("shares")), "hot")
    dealt = F.pmod("_row", F.coalesce("shares", F.lit(1)))
    rows = series.withColumn("_row", F.monotonically_increasing_id()).join(hot, keys, "left")
    rows = rows.withColumn("share", dealt).drop("shares", "_row")
    numbers = numbered_instants(series, gap_ms, seconds).join(hot, keys, "left")
    last = F.coalesce("shares", F.lit(1)) - 1
    copies = numbers.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    drawn = F.when(F.col("wl").isNotNull(), F.col("segment"))
    return (
        rows.join(copies.select(*keys, "segment", "share"), [*keys, "share"])
        .withColumn("segment", drawn)
        .select(*series.columns, "segment")
    )
