"""Day folders: timed tables written as ``dt=<UTC day>``, and what is kept beside them.

A delivery replaces the days it holds, or adds to them, and leaves all others alone. Before it
touches a day, and again when it is done, it leaves a note of its days below ``_changed``; summaries
take the noted days up and remove the notes when they are done. A delivery that fails, or a summary
that runs meanwhile, is therefore made good by the next summary.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.sources.warehouse import DAY, TABLES, read_table

_NOTES = f"{DAY} DATE"


def day_of(ts: str):
    return F.to_date(ts).alias(DAY)


def write_days(rows: DataFrame, path: str, ts: str, mode: str = "overwrite") -> None:
    """Write rows in folders by the UTC day of ``ts``; only days that occur are touched.

    Ranges of (day, time) go to one task each, so a large day is cut into several files whose row
    groups know their time span; the row id lets even copies of one row be cut.
    """
    dealt = rows.withColumn(DAY, F.to_date(ts)).withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(DAY, ts, "_row").sortWithinPartitions(DAY, ts)
    writer = dealt.drop("_row").write.partitionBy(DAY).mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def deliver(rows: DataFrame, root: str, role: str, replace: bool = True) -> None:
    """Deliver rows of a timed table to ``root/<table>``, with a note of the days concerned.

    With ``replace`` a day that occurs in the rows holds just these rows afterwards, so a delivery
    may be repeated. Else its rows are added; a repeated call adds them again. A day without
    rows in the delivery stays as it is. Rows without an instant are left out.
    """
    spec = TABLES[role]
    if spec.instant is None:
        raise ValueError(f"{spec.name} has no time column")
    columns = [f.split(" ")[0] for f in spec.schema.split(", ")]
    rows = rows.select(*columns).where(F.col(spec.instant).isNotNull())
    # Days, not rows: a delivery holds few of them.
    touched = rows.select(day_of(spec.instant)).distinct().collect()
    if not touched:
        return
    note = rows.sparkSession.createDataFrame(touched, _NOTES).coalesce(1)
    note.write.parquet(f"{_notes(root, role)}/{uuid.uuid4().hex}")
    write_days(rows, f"{root}/{spec.name}", spec.instant, "overwrite" if replace else "append")
    note.write.parquet(f"{_notes(root, role)}/{uuid.uuid4().hex}")


def read_days(spark: SparkSession, root: str, role: str) -> DataFrame:
    """The delivered table with its day column."""
    return read_table(spark, root, role, partitioned=True)


def _notes(root: str, role: str) -> str:
    return f"{root}/_changed/{TABLES[role].name}"


def changed(spark: SparkSession, root: str, role: str) -> tuple[list, list[str]]:
    """Days noted by deliveries that no summary has taken up, and the notes themselves.

    Only finished notes count: an unfinished one belongs to a delivery that has not written yet.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(_notes(root, role))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return [], []
    found = [s.getPath().toString() for s in files.listStatus(folder)]
    found = [f for f in found if files.exists(path(f"{f}/_SUCCESS"))]
    if not found:
        return [], []
    days = spark.read.schema(_NOTES).parquet(*found).distinct().collect()
    return sorted(r[DAY] for r in days), found


def forget(spark: SparkSession, notes: list[str]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    for note in notes:
        place = path(note)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
