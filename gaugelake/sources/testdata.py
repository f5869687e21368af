"""Warehouse tables derived from the generated test tables (see FIXTURES.md).

Every row is a function of one source row and a 25-row name table, so the derived tables
grow with their sources and no distinct pass over the events is needed.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Source columns in use. Stated schemas spare a look into the files at every start.
NATION = "n_nationkey INT, n_name STRING"
SUPPLIER = "s_suppkey BIGINT"
CUSTOMER = "c_custkey BIGINT"
LINEITEM = (
    "l_orderkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_linestatus STRING"
)
EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
ORDERS = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING"
)


def _sensor_id(k: str) -> str:
    prefix = f"CASE {k} % 5 WHEN 0 THEN 'BF' WHEN 1 THEN 'CB' WHEN 2 THEN 'DE' WHEN 3 THEN 'NB' ELSE 'OC' END"
    return f"concat({prefix}, '_', lpad(CAST({k} AS STRING), 2, '0'))"


def _camera_id(s: str) -> str:
    tail = f"CASE WHEN {s} >= 50 THEN concat('_', CAST(CAST(floor({s} / 50) AS BIGINT) AS STRING)) ELSE '' END"
    return f"concat('CAM_', {_sensor_id(f'({s} % 50)')}, {tail})"


def _open(spark: SparkSession, sf_dir: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{table}.parquet")


def events_as_readings(events: DataFrame, names: DataFrame) -> DataFrame:
    rows = (
        events.where("event_type <> 'view' AND ts IS NOT NULL")
        .withColumn("k", F.expr("CAST(user_id % 50 AS INT)"))
        .withColumn("j", F.expr("CAST(get_json_object(props, '$.k') AS INT)"))
        .withColumn("road_elevation", F.expr("2.0D + (k % 3) * 0.25D"))
        .withColumn("sensor_water_level", F.expr("floor(value * 5) / 100 - 0.95D"))
        .withColumn("sensor_water_level_adj", F.expr("floor(value * 5) / 100 - 1.0D"))
    )
    return rows.join(names, F.col("k") % 25 == F.col("n_nationkey")).selectExpr(
        "n_name AS place",
        f"{_sensor_id('k')} AS sensor_ID",
        "ts AS date",
        "CASE WHEN k % 17 = 0 THEN NULL ELSE 34.0D + k * 0.01D END AS lat",
        "-77.0D + k * 0.02D AS lng",
        "-1.0D + (k % 4) * 0.25D AS sensor_elevation",
        "road_elevation",
        "CASE WHEN k % 13 = 12 THEN NULL ELSE 1.5D + (k % 3) * 0.25D END AS alert_threshold",
        "sensor_water_level",
        "sensor_water_level - road_elevation AS road_water_level",
        "sensor_water_level_adj",
        "sensor_water_level_adj - road_elevation AS road_water_level_adj",
        "3.2D + j * 0.02D AS voltage",
        "CASE WHEN event_type = 'error' THEN true"
        " WHEN event_type = 'signup' AND j = 0 THEN NULL ELSE false END AS qa_qc_flag",
    )


def _raw(events: DataFrame, names: DataFrame) -> DataFrame:
    rows = events.where("ts IS NOT NULL").withColumn("k", F.expr("CAST(user_id % 50 AS INT)"))
    return rows.join(names, F.col("k") % 25 == F.col("n_nationkey")).selectExpr(
        "n_name AS place",
        f"{_sensor_id('k')} AS sensor_ID",
        "ts AS date",
        "3.2D + CAST(get_json_object(props, '$.k') AS INT) * 0.02D AS voltage",
        "event_type <> 'click' AS processed",
    )


def _surveys(orders: DataFrame) -> DataFrame:
    rows = orders.where("o_orderdate IS NOT NULL").withColumn("k", F.expr("CAST(o_custkey % 50 AS INT)"))
    return rows.selectExpr(
        f"{_sensor_id('k')} AS sensor_ID",
        "o_orderdate AS date_surveyed",
        "concat('Site ', CAST(k AS STRING)) AS sensor_label",
        "CASE WHEN k % 17 = 0 THEN NULL ELSE 34.0D + k * 0.01D END AS lat",
        "-77.0D + k * 0.02D AS lng",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL"
        " ELSE floor(o_totalprice / 5000) / 100 - 1.5D END AS reference_elevation",
        "CASE WHEN o_orderstatus = 'F' THEN 'drain_bottom' ELSE 'land' END AS reference_elevation_type",
        "CAST(k % 10 AS STRING) AS wl_id",
        "CASE k % 3 WHEN 0 THEN 'noaa' WHEN 1 THEN 'FIMAN' ELSE 'Hohonu' END AS wl_src",
        "CASE WHEN k % 3 = 0 THEN 'obs, pred' ELSE 'obs' END AS wl_types",
        "CASE WHEN k % 4 = 3 THEN NULL"
        " ELSE concat('https://example.com/wl/', CAST(k % 10 AS STRING)) END AS wl_url",
        "CAST((k + 1) % 10 AS STRING) AS alt_wl_id",
        "'FIMAN' AS alt_wl_src",
        "'obs' AS alt_wl_types",
        "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN ''"
        " ELSE concat('https://example.com/alt/', CAST((k + 1) % 10 AS STRING)) END AS alt_wl_url",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'NA' ELSE o_orderpriority END AS notes",
    )


def _provider(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "CAST(l_suppkey % 10 AS STRING) AS id",
        "timestampadd(MINUTE, CAST((l_orderkey * 7 + l_linenumber) % 43200 AS INT),"
        " TIMESTAMP '2024-01-01 00:00:00') AS date",
        "round(l_quantity / 10 - 1.0D, 2) AS value",
        "CASE WHEN l_suppkey % 2 = 0 THEN 'FIMAN' ELSE 'HOHONU' END AS api_name",
        "CASE WHEN l_linestatus = 'O' THEN 'water_level' ELSE 'air_temperature' END AS type",
    )


def _cameras(supplier: DataFrame, names: DataFrame) -> DataFrame:
    rows = supplier.withColumnRenamed("s_suppkey", "s")
    return rows.join(names, F.col("s") % 25 == F.col("n_nationkey")).selectExpr(
        f"{_camera_id('s')} AS camera_ID",
        f"CASE WHEN s % 11 = 10 THEN NULL ELSE {_sensor_id('(s % 50)')} END AS sensor_ID",
        "concat('Camera ', CAST(s AS STRING)) AS camera_label",
        "CASE WHEN s % 19 = 18 THEN 'Hawaii' ELSE n_name END AS place",
        "34.0D + (s % 50) * 0.01D AS lat",
        "-77.0D + (s % 50) * 0.02D AS lng",
    )


def _photos(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'view' AND ts IS NOT NULL").selectExpr(
        f"{_camera_id('(user_id % 100)')} AS camera_ID", "ts AS DateTimeOriginalUTC"
    )


class DerivedTables:
    """The fields of ``Warehouse``, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._open = lambda table, schema: _open(spark, sf_dir, table, schema)

    @cached_property
    def _events(self) -> DataFrame:
        return self._open("events", EVENTS)

    @cached_property
    def _names(self) -> DataFrame:
        return self._open("nation", NATION)

    @cached_property
    def readings(self) -> DataFrame:
        return events_as_readings(self._events, self._names)

    @cached_property
    def raw(self) -> DataFrame:
        return _raw(self._events, self._names)

    @cached_property
    def surveys(self) -> DataFrame:
        return _surveys(self._open("orders", ORDERS))

    @cached_property
    def provider(self) -> DataFrame:
        return _provider(self._open("lineitem", LINEITEM))

    @cached_property
    def cameras(self) -> DataFrame:
        return _cameras(self._open("supplier", SUPPLIER), self._names)

    @cached_property
    def photos(self) -> DataFrame:
        return _photos(self._events)


def load(spark: SparkSession, sf_dir: str) -> DerivedTables:
    """The six tables at one scale. Sets the session zone to UTC, which all times assume."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return DerivedTables(spark, sf_dir)


def tide_payloads(provider: DataFrame) -> DataFrame:
    """Tide answers: water levels as observations, other rows as predictions.

    Ids 0-8 get two points per answer, the second six minutes later; answers of id 9 come back
    empty.
    """
    points = "array(" + ", ".join(
        f"named_struct('t', date_format(date + INTERVAL {m} MINUTES, 'yyyy-MM-dd HH:mm'),"
        " 'v', CAST(value AS STRING))"
        for m in (0, 6)
    ) + ")"
    return provider.selectExpr(
        "id",
        "CASE WHEN type = 'water_level' THEN 'obs' ELSE 'pred' END AS type",
        "CASE WHEN id = '9' THEN '{\"data\": [], \"predictions\": []}'"
        f" WHEN type = 'water_level' THEN to_json(named_struct('data', {points}))"
        f" ELSE to_json(named_struct('predictions', {points})) END AS payload",
        "CAST(date AS DATE) AS first_day",
        "CAST(date + INTERVAL 6 MINUTES AS DATE) AS last_day",
    )


def gauge_payloads(provider: DataFrame) -> DataFrame:
    """State gauge answers, two readings per document."""
    readings = ", ".join(
        "'<general><data_time>',"
        f" date_format(date + INTERVAL {m} MINUTES, 'yyyy-MM-dd HH:mm:ss'), '</data_time><data_value>',"
        " CAST(value AS STRING), '</data_value></general>'"
        for m in (0, 6)
    )
    return provider.where("api_name = 'FIMAN' AND type = 'water_level'").selectExpr(
        "id",
        "'obs' AS type",
        f"concat('<onerain><response>', {readings}, '</response></onerain>') AS payload",
        "CAST(date AS DATE) AS first_day",
        "CAST(date + INTERVAL 6 MINUTES AS DATE) AS last_day",
    )


def _by_day(provider: DataFrame, kind: str) -> DataFrame:
    """Provider rows gathered by station, kind and day."""
    point = F.struct(F.date_format("date", "yyyy-MM-dd HH:mm").alias("t"), F.col("value").cast("string").alias("v"))
    days = provider.groupBy("id", F.expr(kind).alias("type"), F.to_date("date").alias("first_day"))
    return days.agg(F.sort_array(F.collect_list(point)).alias("points")).withColumn("last_day", F.col("first_day"))


def tide_day_payloads(provider: DataFrame) -> DataFrame:
    """Tide answers of a whole day. Those of id 9 come back empty, those of id 8 cut short."""
    rows = _by_day(provider, "CASE WHEN type = 'water_level' THEN 'obs' ELSE 'pred' END")
    text = F.when(F.col("type") == "obs", F.to_json(F.struct(F.col("points").alias("data"))))
    text = text.otherwise(F.to_json(F.struct(F.col("points").alias("predictions"))))
    text = F.when(F.col("id") == "9", '{"error": {"message": "No data was found."}}').otherwise(text)
    text = F.when(F.col("id") == "8", text.substr(F.lit(1), F.length(text) - 5)).otherwise(text)
    return rows.select("id", "type", text.alias("payload"), "first_day", "last_day")


def gauge_day_payloads(provider: DataFrame) -> DataFrame:
    """State gauge answers of a whole day; those of id 8 end within the answer."""
    rows = _by_day(provider.where("api_name = 'FIMAN' AND type = 'water_level'"), "'obs'")
    points = F.transform(
        "points",
        lambda p: F.concat(
            F.lit("<general><data_time>"), p["t"], F.lit(":00</data_time><data_value>"), p["v"],
            F.lit("</data_value></general>"),
        ),
    )
    text = F.concat(F.lit("<onerain><response>"), F.array_join(points, ""), F.lit("</response></onerain>"))
    text = F.when(F.col("id") == "8", F.replace(text, F.lit("</data_time>"), F.lit(""))).otherwise(text)
    return rows.select("id", "type", text.alias("payload"), "first_day", "last_day")


def gauge_key_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge-key lines from the suppliers; every tenth line is empty."""
    return _open(spark, sf_dir, "supplier", SUPPLIER).selectExpr(
        "CASE WHEN s_suppkey % 10 = 9 THEN ',,,,,,' ELSE concat("
        "'\"Place ', s_suppkey, ', North Carolina\",Gauge @ ', s_suppkey, ',',"
        " CASE WHEN s_suppkey % 4 = 3 THEN 'OCAN' ELSE '' END, s_suppkey % 10, ',', s_suppkey, ',',"
        " CASE WHEN s_suppkey % 3 = 0 THEN 'Water Elevation' ELSE 'Battery' END, ',',"
        " CASE WHEN s_suppkey % 2 = 0 THEN 'HG' ELSE CAST(s_suppkey AS STRING) END, ',') END AS line"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart requests from the orders: 5 days backwards to 45 days forwards."""
    return _open(spark, sf_dir, "orders", ORDERS).selectExpr(
        "o_orderkey AS request_id",
        "CAST(o_orderdate AS DATE) AS first_day",
        "date_add(CAST(o_orderdate AS DATE), CAST(o_custkey % 51 AS INT) - 5) AS last_day",
        "o_orderstatus = 'P' AS admin",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses from the customers: by sensor, by place, by both, unknown, or neither."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sensor = f"concat('sensor_ID=', {_sensor_id('(c_custkey % 50)')})"
    place = "concat('location=NATION%5F', c_custkey % 25)"
    return _open(spark, sf_dir, "customer", CUSTOMER).selectExpr(
        "c_custkey AS link_id",
        "concat('https://example.com/', CASE c_custkey % 6"
        f" WHEN 0 THEN '' WHEN 1 THEN concat('?', {sensor}) WHEN 2 THEN concat('?', {place})"
        f" WHEN 3 THEN concat('?', {place}, '&', {sensor})"
        " WHEN 4 THEN '?sensor_ID=ZZ_99' ELSE '?location=Hawaii' END) AS url",
    )
