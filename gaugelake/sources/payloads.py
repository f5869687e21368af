"""Landed service answers (JSON and XML documents in a column) as rows.

A payload table holds one answer per row with the station and the kind of request it
answers. Unreadable numbers and times become NULL. Answers without a single row are not an
error for the others: ``tide_rejects`` lists them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.schemas import GAUGE_XML, TIDE_JSON
from gaugelake.settle import dealt_out

# Fixed values: (request kind, list in the answer, entity, note).
TIDE_KINDS = {
    "obs": ("data", "NOAA Observed", "observation"),
    "pred": ("predictions", "NOAA Predictions", "prediction"),
}


def asked_between(payloads: DataFrame, first, last) -> DataFrame:
    """Answers to requests that touch a range of days; unknown days may touch any."""
    return payloads.where(
        F.coalesce(F.col("last_day") >= first, F.lit(True))
        & F.coalesce(F.col("first_day") <= last, F.lit(True))
    )


def tide_points(payloads: DataFrame, answer: Column | None = None) -> DataFrame:
    """Each answer's list of the kind it was asked for; a document is parsed once."""
    if answer is None:
        answer = F.from_json("payload", TIDE_JSON)
    points = F.lit(None)
    for kind, (field, _, _) in TIDE_KINDS.items():
        points = F.when(F.col("type") == kind, F.col("answer")[field]).otherwise(points)
    return payloads.withColumn("answer", answer).withColumn("points", points)


def _each(answers: DataFrame, points) -> DataFrame:
    """One row per list entry. From a plain ``explode`` Spark would infer a filter on the
    list's size and push it down, which parses every document a second time."""
    rows = answers.select("id", "type", F.explode_outer(points).alias("point"))
    return rows.where(F.col("point").isNotNull())


def tide_rows(payloads: DataFrame, *kinds: str) -> DataFrame:
    """Observed (``obs``) and predicted (``pred``) tide levels, with the ``type`` asked for."""
    texts = {
        name: F.coalesce(*(F.when(F.col("type") == k, TIDE_KINDS[k][n]) for k in kinds))
        for n, name in ((1, "entity"), (2, "notes"))
    }
    asked = dealt_out(payloads.where(F.col("type").isin(list(kinds))))
    rows = _each(tide_points(asked), F.col("points"))
    return rows.select(
        "id",
        "type",
        F.try_to_timestamp(F.col("point.t"), F.lit("yyyy-MM-dd HH:mm")).alias("date"),
        F.col("point.v").try_cast("double").alias("level"),
        texts["entity"].alias("entity"),
        texts["notes"].alias("notes"),
    )


def tide_rejects(payloads: DataFrame, kind: str) -> DataFrame:
    """Answers that hold no rows ("No data available")."""
    rows = F.coalesce(F.size("points"), F.lit(0))
    asked = tide_points(payloads.where(F.col("type") == kind))
    return asked.where(rows <= 0).select("id", "type", "payload")


def gauge_rows(payloads: DataFrame, entity: str = "FIMAN") -> DataFrame:
    """Readings of the state gauge network's XML answers."""
    answer = F.from_xml("payload", GAUGE_XML)
    return gauge_points(payloads, answer["response"]["general"], entity)


def gauge_points(answers: DataFrame, points: Column, entity: str = "FIMAN") -> DataFrame:
    """One row for each reading in the lists of gauge answers."""
    return (
        _each(answers, points)
        .select(
            "id",
            F.try_to_timestamp(F.col("point.data_time"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("date"),
            F.col("point.data_value").try_cast("double").alias("level"),
            F.lit(entity).alias("entity"),
            F.lit("observation").alias("notes"),
        )
    )
