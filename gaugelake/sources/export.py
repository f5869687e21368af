"""The CSV download: one folder of ordered part files per sensor, or one file under its own name."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gaugelake.functions.clock import local_midnight
from gaugelake.sources.named_files import write_named

# Column headings of the exported file.
HEADINGS = {
    "date": "timestamp (UTC)",
    "sensor_elevation": "sensor elev. (ft NAVD88)",
    "road_elevation": "road elev. (ft NAVD88)",
    "sensor_water_level_adj": "water level (ft NAVD88)",
    "road_water_level_adj": "water level (ft above or below road elev.)",
}


def _exported_columns():
    date = F.date_format("date", "MM/dd/yyyy HH:mm").alias(HEADINGS["date"])
    return [date, *(F.round(c, 2).alias(h) for c, h in HEADINGS.items() if c != "date")]


def download_table(series: DataFrame) -> DataFrame:
    """The exported columns, rounded and under their headings, with ``sensor_ID``."""
    return series.select("sensor_ID", *_exported_columns())


def export_name(start, end):
    """``<sensor>_<first day>_<last day>.csv`` with the UTC days of the bounds."""
    bounds = [F.date_format(local_midnight(d), "yyyyMMdd") for d in (start, end)]
    return F.concat_ws("_", "sensor_ID", bounds[0], F.concat(bounds[1], F.lit(".csv")))


def write_download(series: DataFrame, start, end, path: str) -> None:
    """Write every sensor's file below ``path``, rows in time order.

    Range partitioning on (sensor, time) cuts a sensor with many readings into several
    consecutive parts instead of sending it to one task; the row id lets even copies of one
    reading be cut. Part numbers follow time.
    """
    order = ["file", "date", "row"]
    (
        series.withColumn("file", export_name(start, end))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("file", *_exported_columns())
        .write.partitionBy("file")
        .option("header", True)
        .option("nullValue", "NA")
        .csv(path)
    )


def write_named_download(series: DataFrame, start, end, path: str) -> None:
    """Write one file per sensor below ``path``, named as the download is, rows in time order.

    A sensor's file is written by one task, which streams its sorted rows; for very long series
    ``write_download`` cuts files into parts. Nothing is seen before all files are whole. A sensor's
    readings without a name (NULL) are left out.
    """
    line = F.to_csv(F.struct(*_exported_columns()), {"nullValue": "NA"})
    rows = series.where("sensor_ID IS NOT NULL").select(export_name(start, end).alias("file"), "date", line.alias("line"))
    dealt = rows.repartition("file").sortWithinPartitions("file", "date", "line")
    header = ",".join(HEADINGS.values())
    write_named(dealt, path, header)


def read_named_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of named files with their number: rows (file, line, text), the header being line 0.

    Files are read whole, so this is for checks of downloads, not for tables.
    """
    texts = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -1)
    lines = F.split(F.regexp_replace("value", "\\n\\z", ""), "\n")
    return texts.select(name.alias("file"), F.posexplode(lines).alias("line", "text"))


def read_download(spark: SparkSession, path: str) -> DataFrame:
    """Rows of written files, with the file each is in; the order is that of the files' lines."""
    first, *rest = HEADINGS.values()
    fields = [StructField(first, StringType()), *(StructField(h, DoubleType()) for h in rest)]
    schema = StructType([*fields, StructField("file", StringType())])
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
