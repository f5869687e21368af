"""The six warehouse tables, from Parquet folders or over JDBC."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from gaugelake import schemas


#: The day folders of partitioned tables.
DAY = "dt"


class Warehouse(NamedTuple):
    readings: DataFrame
    raw: DataFrame
    surveys: DataFrame
    provider: DataFrame
    cameras: DataFrame
    photos: DataFrame


class TableSpec(NamedTuple):
    name: str
    schema: str
    instant: str | None  # the time column; rows without it carry no usable fact


TABLES = {
    "readings": TableSpec("data_for_display", schemas.READINGS, "date"),
    "raw": TableSpec("sensor_data", schemas.RAW, "date"),
    "surveys": TableSpec("sensor_surveys", schemas.SURVEYS, "date_surveyed"),
    "provider": TableSpec("api_data", schemas.PROVIDER, "date"),
    "cameras": TableSpec("camera_locations", schemas.CAMERAS, None),
    "photos": TableSpec("photo_info", schemas.PHOTOS, "DateTimeOriginalUTC"),
}


def _timed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Zone-aware instants, and no rows without one."""
    if spec.instant is None:
        return df
    if dict(df.dtypes)[spec.instant] != "timestamp":
        df = df.withColumn(spec.instant, F.col(spec.instant).cast("timestamp"))
    return df.where(F.col(spec.instant).isNotNull())


def read_table(spark: SparkSession, root: str, role: str, partitioned: bool = False) -> DataFrame:
    """One table below ``root``, by its role in ``Warehouse``; ``partitioned`` as in ``from_parquet``."""
    spec = TABLES[role]
    days = f", {DAY} DATE" if partitioned and spec.instant else ""
    return _timed(spark.read.schema(spec.schema + days).parquet(f"{root}/{spec.name}"), spec)


def from_parquet(spark: SparkSession, root: str, partitioned: bool = False) -> Warehouse:
    """Open ``root/<table>`` for each table.

    ``partitioned`` says that timed tables are laid out in folders ``dt=<day>``, the UTC or the
    local day of their instant (``sources.days`` writes UTC days). Range filters then prune
    folders, see ``on_days``.
    """
    return Warehouse(**{role: read_table(spark, root, role, partitioned) for role in TABLES})


def on_days(df: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Prune by day where there is a day column; exact filters on the instant must follow.

    A day more is kept on each side, since days may be counted in either zone.
    """
    if DAY not in df.columns:
        return df
    if first is not None:
        df = df.where(F.col(DAY) >= F.date_sub(first, 1))
    if last is not None:
        df = df.where(F.col(DAY) <= F.date_add(last, 1))
    return df


def from_jdbc(
    spark: SparkSession, url: str, since: str, until: str, tasks: int = 64, properties=None
) -> Warehouse:
    """Open the tables in a relational warehouse.

    Timed tables are read by ``tasks`` range queries on their time column; ``since`` and
    ``until`` only place the cuts, rows outside them are still read by the outer tasks.
    """
    properties = dict(properties or {})

    def rows(spec: TableSpec) -> DataFrame:
        if spec.instant is None:
            return spark.read.jdbc(url, spec.name, properties=properties)
        return spark.read.jdbc(
            url,
            spec.name,
            column=spec.instant,
            lowerBound=since,
            upperBound=until,
            numPartitions=tasks,
            properties=properties,
        )

    def table(spec: TableSpec) -> DataFrame:
        """The columns of the schema, whatever else the database holds."""
        fields = StructType.fromDDL(spec.schema).fields
        return rows(spec).select(*(F.col(f.name).cast(f.dataType) for f in fields))

    return Warehouse(**{role: _timed(table(spec), spec) for role, spec in TABLES.items()})


def water_levels(provider: DataFrame) -> DataFrame:
    """Third-party rows that are water levels."""
    return provider.where(F.col("type") == schemas.WATER_LEVEL)
