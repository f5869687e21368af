"""Service answers landed as files, one document each, as payload tables and rejects.

A document's folder names its request: ``id=<station>/type=<kind>/days=<first>_<last>``, days as
``yyyymmdd``. Files may have any name and sit in further folders below. JSON documents are read whole;
XML answers are read by Spark's XML source, one row for each answer element.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.schemas import GAUGE_XML, TIDE_JSON
from gaugelake.sources.payloads import gauge_points, tide_points

#: Station, kind and days in a path.
REQUEST = r"/id=([A-Za-z0-9_.-]+)/type=([A-Za-z0-9_.-]+)/days=(\d{8})_(\d{8})/"
CORRUPT = "_corrupt"


def write_documents(payloads: DataFrame, root: str, spread: int = 1) -> None:
    """Write each payload as a file of its own below its request's folder.

    ``spread`` further folders part the answers to one request among tasks.
    """
    named = payloads.select(
        "id",
        "type",
        F.concat_ws("_", *(F.date_format(d, "yyyyMMdd") for d in ("first_day", "last_day"))).alias("days"),
        F.pmod(F.xxhash64("payload"), F.lit(spread)).alias("share"),
        F.monotonically_increasing_id().alias("answer"),
        "payload",
    )
    dealt = named.repartition("id", "type", "days", "share").drop("share")
    dealt.write.partitionBy("id", "type", "days", "answer").mode("append").text(root)


def _requests(df: DataFrame) -> DataFrame:
    """Add what the path says of the request; NULL where it says nothing."""

    def part(n: int) -> Column:
        found = F.regexp_extract("path", REQUEST, n)
        return F.when(found != "", found)

    def day(n: int) -> Column:
        return F.try_to_timestamp(part(n), F.lit("yyyyMMdd")).cast("date")

    return df.withColumns({"id": part(1), "type": part(2), "first_day": day(3), "last_day": day(4)})


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Whole documents as a payload table: id, type, payload, first_day, last_day, path."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    found = files.select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path"))
    return _requests(found).select("id", "type", "payload", "first_day", "last_day", "path")


def tide_file_rejects(documents: DataFrame) -> DataFrame:
    """Documents that give no rows: path, id, type and the reason.

    ``path``: the folders don't name a request. ``unreadable``: not JSON. ``empty``: JSON without a
    row of the kind asked for. A document is parsed once.
    """
    answer = F.from_json("payload", f"{TIDE_JSON}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})
    read = tide_points(documents, answer)
    unreadable = F.col("answer").isNull() | F.col(f"answer.{CORRUPT}").isNotNull()
    reason = (
        F.when(F.col("id").isNull(), "path")
        .when(unreadable, "unreadable")
        .when(F.coalesce(F.size("points"), F.lit(0)) <= 0, "empty")
    )
    judged = read.select("path", "id", "type", reason.alias("reason"))
    return judged.where(F.col("reason").isNotNull())


def _gauge_answers(spark: SparkSession, root: str) -> DataFrame:
    """One row for each answer element: response (as in the payload schema), corrupt text, path."""
    fields = GAUGE_XML.removeprefix("response STRUCT<").removesuffix(">").replace("general:", "general", 1)
    rows = (
        spark.read.format("xml")
        .option("rowTag", "response")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
        .schema(f"{fields}, {CORRUPT} STRING")
        .load(root)
    )
    return _requests(rows.select("general", CORRUPT, F.col("_metadata.file_path").alias("path")))


def gauge_file_rows(spark: SparkSession, root: str) -> DataFrame:
    """Readings of the gauge network's answers in files."""
    whole = _gauge_answers(spark, root).where(F.col(CORRUPT).isNull() & F.col("id").isNotNull())
    return gauge_points(whole, F.col("general"))


def gauge_file_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Files that give no rows or hold a broken answer: path, id, type and the reason.

    ``path`` and ``empty`` as for JSON; ``unreadable``: an answer that is no XML, or no answer at all.
    """
    answers = _gauge_answers(spark, root).groupBy("path").agg(
        F.max(F.col(CORRUPT).isNotNull()).alias("broken"),
        F.sum(F.coalesce(F.size("general"), F.lit(0))).alias("rows"),
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = _requests(files.select(F.col("_metadata.file_path").alias("path")))
    judged = named.join(answers, "path", "left")
    reason = (
        F.when(F.col("id").isNull(), "path")
        .when(F.coalesce("broken", F.lit(True)), "unreadable")
        .when(F.col("rows") <= 0, "empty")
    )
    return judged.select("path", "id", "type", reason.alias("reason")).where(F.col("reason").isNotNull())
