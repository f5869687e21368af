"""Named queries over the generated test tables.

Each takes ``(spark, sf_dir)`` and covers whole tables. Moment and range are fixed so that
results can be compared.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.functions.text import glue
from gaugelake.operators import (
    day_summary,
    health,
    latest,
    links,
    overlays,
    places,
    segments,
    series,
    status,
    timeline,
    timeline_store,
)
from gaugelake.schemas import LOOKBACK_DAYS
from gaugelake.settle import fresh_path, settle, together
from gaugelake.sources import days, export, gauge_key, landed, payloads, testdata
from gaugelake.sources.warehouse import Warehouse, water_levels
from gaugelake.streaming import change_log, counts, snapshot

AS_OF = "2024-01-30 23:59:00"
# The longest range that may be charted with overlays; it spans the tables.
START, END = "2024-01-01", "2024-01-31"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    """Register a query on the warehouse tables under its function name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(testdata.load(spark, sf_dir))
    return build


def session_query(build: Query) -> Query:
    """Register a query that needs the session and the folder itself."""
    QUERIES[build.__name__] = build
    return build


# Shared inputs. Per-sensor tables are settled where several parts of a query use them.


def _newest(w: Warehouse) -> DataFrame:
    """The newest readings of all time: map rows and status both follow from them."""
    return settle(latest.newest_rows(w.readings, ["sensor_ID"], "date"), "newest")


def _surveys(w: Warehouse) -> DataFrame:
    return settle(latest.latest_surveys(w.surveys), "surveys")


def _constants(w: Warehouse) -> DataFrame:
    recent = latest.latest_sensors(
        w.readings.select(
            "sensor_ID", "date", "lat", "lng", "sensor_elevation", "road_elevation",
            "sensor_water_level_adj", "road_water_level_adj",
        ),
        AS_OF,
        LOOKBACK_DAYS,
    )
    return settle(series.sensor_constants(recent), "constants")


def _references(w: Warehouse) -> DataFrame:
    return latest.reference_elevations(latest.latest_surveys(w.surveys))


def _series(w: Warehouse) -> DataFrame:
    return series.sensor_series(w.readings, START, END)


def mapped_rows(
    w: Warehouse, newest: DataFrame | None = None, surveys: DataFrame | None = None
) -> DataFrame:
    """Labelled map rows of the sensors, from the newest readings where these are known.

    What has been found about those (age and status, from ``judge``) stays on the rows.
    """
    labels = latest.sensor_labels(latest.latest_surveys(w.surveys) if surveys is None else surveys)
    if newest is None:
        sensors = latest.latest_sensors(w.readings, AS_OF, LOOKBACK_DAYS)
    else:
        sensors = latest.recent_sensors(newest, AS_OF, LOOKBACK_DAYS)
    return places.sensor_map(sensors, labels)


def _located(w: Warehouse) -> DataFrame:
    return places.camera_map(places.camera_locations(w.cameras, w.photos))


# Status


@query
def q_flood_status(w):
    return status.flood_status(w.readings, AS_OF)


@query
def q_status_banner(w):
    return status.status_banner(status.flood_status(w.readings, AS_OF))


@query
def q_missing_interval(w):
    newest = _newest(w)
    sensors = latest.recent_sensors(newest, AS_OF, LOOKBACK_DAYS)
    return status.missing_interval(sensors, status.judge(newest, AS_OF), AS_OF)


@query
def q_status_timeline(w):
    return timeline.status_timeline(w.readings)


# Newest rows


@query
def q_top3(w):
    top = latest.newest_ranked(w.readings.select("sensor_ID", "date"), ["sensor_ID"], "date", 3)
    return top.select("sensor_ID", "date", "rnk")


@query
def q_sample_interval(w):
    top = latest.newest_ranked(w.readings.select("sensor_ID", "date"), ["sensor_ID"], "date", 3)
    return latest.sample_interval(top)


@query
def q_latest_sensor(w):
    return latest.latest_sensors(w.readings, AS_OF, LOOKBACK_DAYS).select(
        "sensor_ID", "date", "place", "lng", "lat", "road_water_level"
    )


@query
def q_latest_survey(w):
    return latest.latest_surveys(w.surveys).select("sensor_ID", "date_surveyed", "sensor_label")


@query
def q_sensor_labels(w):
    return latest.sensor_labels(latest.latest_surveys(w.surveys))


@query
def q_reference_elevations(w):
    return _references(w)


@query
def q_latest_photo(w):
    return latest.latest_photos(w.photos)


@query
def q_latest_raw(w):
    return latest.latest_raw(w.raw)


# Map and places


def sensor_map_rows(w: Warehouse) -> DataFrame:
    newest, surveys = together(lambda: _newest(w), lambda: latest.latest_surveys(w.surveys))
    rows = mapped_rows(w, status.judge(newest, AS_OF), surveys)
    return status.status_color(rows, grey_when_missing=False)


@query
def q_sensor_map(w):
    return sensor_map_rows(w).select(
        "sensor_ID",
        "sensor_label",
        "place",
        "flood_status",
        "flood_color",
        "popup",
        places.view_popup(F.col("popup")).alias("view_popup"),
    )


@query
def q_camera_locations(w):
    return places.camera_locations(w.cameras, w.photos).select(
        "camera_ID", "place", "sensor_ID", "lng", "lat", "DateTimeOriginalUTC"
    )


def camera_map_rows(w: Warehouse) -> DataFrame:
    found, located = together(lambda: status.flood_status(w.readings, AS_OF), lambda: _located(w))
    joined = located.join(found.select("sensor_ID", "flood_status").distinct(), "sensor_ID", "left")
    return status.status_color(joined, grey_when_missing=True)


@query
def q_camera_map(w):
    return camera_map_rows(w).select("camera_ID", "camera_label", "flood_status", "flood_color", "popup")


@query
def q_camera_caption(w):
    return places.camera_caption(latest.latest_photos(w.photos))


@query
def q_place_list(w):
    return places.place_list(mapped_rows(w), w.cameras)


@query
def q_place_view(w):
    view = places.place_view(mapped_rows(w), w.cameras)
    return view.select("place", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "zoom")


@query
def q_start_view(w):
    """Places whose name ends in 0 stand for no place selected."""
    view = places.place_view(mapped_rows(w), w.cameras)
    chosen = F.when(~F.col("place").endswith("0"), F.col("place"))
    view = places.start_view(view.withColumn("place", chosen))
    return view.select("place", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "zoom")


@query
def q_place_choices(w):
    sensors = places.place_choices(settle(mapped_rows(w), "mapped"), "sensor_ID", "sensor_label")
    cameras = places.place_choices(
        w.cameras.withColumn("camera_label", glue(F.col("camera_label"), " (", F.col("camera_ID"), ")")),
        "camera_ID",
        "camera_label",
    )
    return sensors.withColumn("kind", F.lit("sensor")).unionByName(
        cameras.withColumn("kind", F.lit("camera"))
    )


@query
def q_site_rules(w):
    return places.site_rules(mapped_rows(w))


@query
def q_site_notes(w):
    return places.site_notes(latest.latest_surveys(w.surveys))


@session_query
def q_deeplink(spark, sf_dir):
    w = testdata.load(spark, sf_dir)
    parsed = links.parse_links(testdata.links(spark, sf_dir))
    surveys = _surveys(w)
    view = places.place_view(mapped_rows(w, surveys=surveys), w.cameras)
    found = links.resolve_links(parsed, surveys, view)
    return found.withColumns({"lng": F.round("lng", 6), "lat": F.round("lat", 6)})


# Series


@query
def q_sensor_series(w):
    return _series(w).select(
        "sensor_ID",
        "date",
        "sensor_water_level_adj",
        "road_water_level_adj",
        "sensor_water_level",
        "road_water_level",
    )


#: Sensors picked by hand in a chart.
PICKED = ["CB_01", "BF_05", "NB_13", "ZZ_99"]


@query
def q_series_picked(w):
    """A list of sensors, and a table of them: those with a camera."""
    by_list = series.sensor_series(w.readings, START, END, PICKED)
    by_table = series.sensor_series(w.readings, START, END, w.cameras.select("sensor_ID"))
    columns = ["sensor_ID", "date", "sensor_water_level_adj", "picked"]
    rows = by_list.withColumn("picked", F.lit("list")).select(*columns)
    return rows.unionByName(by_table.withColumn("picked", F.lit("table")).select(*columns))


@session_query
def q_request_guard(spark, sf_dir):
    return series.request_guard(testdata.requests(spark, sf_dir))


@query
def q_blank_dry(w):
    return series.blank_dry(_series(w), _constants(w))


@query
def q_gap_segments(w):
    return segments.gap_segments(series.blank_dry(_series(w), _constants(w), series.NAVD88))


@query
def q_line_points(w):
    drawn = series.blank_dry(_series(w), _constants(w), series.NAVD88)
    return segments.with_segments(drawn).select("sensor_ID", "date", "wl", "segment")


@query
def q_axis_bounds(w):
    return series.axis_bounds(_series(w), _constants(w), _references(w))


@query
def q_axis_bounds_overlay(w):
    return series.axis_bounds(_series(w), _constants(w), _references(w), overlay=True)


@query
def q_ref_lines(w):
    return series.reference_lines(_constants(w), _references(w), AS_OF)


@query
def q_no_data(w):
    return series.no_data(_constants(w), _series(w), overlays.shown_by_default())


@query
def q_download(w):
    return export.download_table(_series(w)).withColumn("file", export.export_name(START, END))


@session_query
def q_download_files(spark, sf_dir):
    """The files written and read back."""
    path = fresh_path(spark, "download")
    export.write_download(_series(testdata.load(spark, sf_dir)), START, END, path)
    return export.read_download(spark, path)


@session_query
def q_named_files(spark, sf_dir):
    """One file per sensor under its exact name: the numbered lines and their times."""
    path = fresh_path(spark, "named")
    export.write_named_download(_series(testdata.load(spark, sf_dir)), START, END, path)
    lines = export.read_named_lines(spark, path).where("line > 0")
    time = F.substring_index("text", ",", 1)
    return lines.select("file", "line", time.alias("time"))


# Third-party levels


@query
def q_thirdparty_obs(w):
    return overlays.provider_observations(w.provider, START, END)


@query
def q_thirdparty_reversed(w):
    """The range given the wrong way round."""
    return overlays.provider_observations(w.provider, END, START)


def _gauges(w: Warehouse) -> DataFrame:
    named = latest.latest_surveys(w.surveys).select(
        F.col("wl_id").alias("id"), F.upper("wl_src").alias("src"), F.lit("obs").alias("want")
    )
    return settle(named.distinct(), "gauges")


@query
def q_thirdparty_union(w):
    rows = overlays.dispatched(
        _gauges(w), w.provider, testdata.tide_payloads(w.provider), START, END
    )
    return rows.groupBy("id", "src").agg(
        F.count(F.lit(1)).alias("n"), F.min("level").alias("low"), F.max("level").alias("high")
    )


@query
def q_tide_json_obs(w):
    return payloads.tide_rows(testdata.tide_payloads(w.provider), "obs").drop("type")


@query
def q_tide_json_pred(w):
    return payloads.tide_rows(testdata.tide_payloads(w.provider), "pred").drop("type")


@query
def q_tide_rejects(w):
    answers = testdata.tide_payloads(w.provider)
    rejects = payloads.tide_rejects(answers, "obs").unionByName(payloads.tide_rejects(answers, "pred"))
    return rejects.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def q_gauge_xml(w):
    return payloads.gauge_rows(testdata.gauge_payloads(w.provider))


def _landed(spark: SparkSession, documents: DataFrame) -> str:
    root = fresh_path(spark, "landed")
    landed.write_documents(documents, root)
    return root


def _tide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = testdata.tide_day_payloads(testdata.load(spark, sf_dir).provider)
    return landed.read_documents(spark, _landed(spark, answers))


@session_query
def q_tide_files(spark, sf_dir):
    """Answers written as files and read as documents; the request comes from the path."""
    return payloads.tide_rows(_tide_files(spark, sf_dir), "obs", "pred")


@session_query
def q_tide_file_rejects(spark, sf_dir):
    rejects = landed.tide_file_rejects(_tide_files(spark, sf_dir))
    return rejects.groupBy("id", "type", "reason").agg(F.count(F.lit(1)).alias("n"))


def _gauge_files(spark: SparkSession, sf_dir: str) -> str:
    return _landed(spark, testdata.gauge_day_payloads(testdata.load(spark, sf_dir).provider))


@session_query
def q_gauge_files(spark, sf_dir):
    return landed.gauge_file_rows(spark, _gauge_files(spark, sf_dir))


@session_query
def q_gauge_file_rejects(spark, sf_dir):
    rejects = landed.gauge_file_rejects(spark, _gauge_files(spark, sf_dir))
    return rejects.groupBy("id", "reason").agg(F.count(F.lit(1)).alias("n"))


@session_query
def q_gauge_key(spark, sf_dir):
    return gauge_key.parse_gauge_key(testdata.gauge_key_lines(spark, sf_dir))


@session_query
def q_gauge_key_file(spark, sf_dir):
    """The key as files, read back."""
    path = fresh_path(spark, "key")
    key = gauge_key.parse_gauge_key(testdata.gauge_key_lines(spark, sf_dir))
    key.write.option("header", True).csv(path)
    return gauge_key.read_gauge_key(spark, path)


@session_query
def q_gauge_lookup(spark, sf_dir):
    """Every newest survey with every water-elevation row of its gauge."""
    key = gauge_key.parse_gauge_key(testdata.gauge_key_lines(spark, sf_dir))
    newest = latest.latest_surveys(testdata.load(spark, sf_dir).surveys)
    return gauge_key.survey_keys(key, settle(newest, "surveys"))


@query
def q_overlay_meta(w):
    return overlays.overlay_meta(latest.latest_surveys(w.surveys))


def _overlay(w: Warehouse, meta: DataFrame, constants: DataFrame, *kinds: str) -> DataFrame:
    return overlays.overlay_series(
        meta, constants, w.provider, testdata.tide_payloads(w.provider), START, END, *kinds
    )


def _overlay_query(w: Warehouse, kind: str) -> DataFrame:
    meta = overlays.overlay_meta(latest.latest_surveys(w.surveys))
    return _overlay(w, meta, _constants(w), kind).drop("kind")


@query
def q_overlay_obs(w):
    return _overlay_query(w, "obs")


@query
def q_overlay_pred(w):
    return _overlay_query(w, "pred")


@query
def q_overlay_alt(w):
    return _overlay_query(w, "alt")


def _chart(w: Warehouse, admin: bool) -> DataFrame:
    surveys, constants = together(lambda: _surveys(w), lambda: _constants(w))
    meta = overlays.overlay_meta(surveys)
    drawn = _overlay(w, meta, constants, "obs", "pred", "alt")
    return series.chart_series(_series(w), constants, [drawn], admin)


@query
def q_chart_series(w):
    return _chart(w, admin=False)


@query
def q_chart_series_admin(w):
    return _chart(w, admin=True)


@query
def q_provider_levels(w):
    return water_levels(w.provider).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("newest")
    )


# Health


@query
def q_natural_join(w):
    joined = health.join_raw(mapped_rows(w), latest.latest_raw(w.raw))
    return joined.select("sensor_ID", "raw_data_date", "processed")


@query
def q_intended_join(w):
    joined = health.join_raw(mapped_rows(w), latest.latest_raw(w.raw), natural=False)
    return joined.select("sensor_ID", "raw_data_date", "processed")


def health_rows(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    newest, surveys, raw, located = together(
        lambda: _newest(w),
        lambda: latest.latest_surveys(w.surveys),
        lambda: latest.latest_raw(w.raw),
        lambda: _located(w),
    )
    cameras = health.camera_health(located, AS_OF)
    sensors = health.sensor_health(mapped_rows(w, status.judge(newest, AS_OF), surveys), raw, cameras)
    return sensors, cameras


@query
def q_sensor_health(w):
    return health_rows(w)[0].select(
        "sensor_ID", "label", "no_data_error", "gateway_error", "processing_error"
    )


@query
def q_camera_health(w):
    return health.camera_health(_located(w), AS_OF).select("camera_ID", "age", "age_text", "label")


@query
def q_battery(w):
    return health.battery_band(mapped_rows(w))


@query
def q_place_panel(w):
    sensors, cameras = health_rows(w)
    return health.place_panel(settle(sensors, "health"), settle(cameras, "cameras"))


# Streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as a stream. The bracket makes the path a pattern, which a stream of
    one file needs; a folder of that name matches too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.readStream.schema(testdata.EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    names = spark.read.schema(testdata.NATION).parquet(f"{sf_dir}/nation.parquet")
    return testdata.events_as_readings(events, names)


def _drained_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = _event_stream(spark, sf_dir)
    folder, checkpoint = fresh_path(spark, "snapshot"), fresh_path(spark, "stream")
    snapshot.maintain_snapshot(readings, folder, checkpoint, availableNow=True).awaitTermination()
    return snapshot.read_snapshot(spark, folder, readings.schema)


@session_query
def q_stream_latest(spark, sf_dir):
    return _drained_snapshot(spark, sf_dir).select("sensor_ID", "date")


@session_query
def q_stream_status(spark, sf_dir):
    judged = status.judge(_drained_snapshot(spark, sf_dir), AS_OF)
    return judged.select("sensor_ID", "time_since_measurement", "flood_status")


def _drained_log(readings: DataFrame, folder: str) -> DataFrame:
    checkpoint = fresh_path(readings.sparkSession, "stream")
    change_log.maintain_changes(readings, folder, checkpoint, availableNow=True).awaitTermination()
    return change_log.ChangeLog(readings.sparkSession, folder).read()


@session_query
def q_stream_changes(spark, sf_dir):
    return _drained_log(_event_stream(spark, sf_dir), fresh_path(spark, "changes"))


#: A moment in the middle of the record.
MIDDLE = "2024-01-16 00:00:00"


@session_query
def q_stream_changes_resumed(spark, sf_dir):
    """A stream that starts in the middle of the record, from the timeline of what came before."""
    folder = fresh_path(spark, "changes")
    log = change_log.ChangeLog(spark, folder)
    log.begin(testdata.load(spark, sf_dir).readings, MIDDLE)
    return _drained_log(_event_stream(spark, sf_dir).where(F.col("date") >= MIDDLE), folder)


@session_query
def q_stream_counts(spark, sf_dir):
    """Every reading is delivered twice."""
    folder, checkpoint = fresh_path(spark, "counts"), fresh_path(spark, "stream")
    twice = _event_stream(spark, sf_dir).unionByName(_event_stream(spark, sf_dir))
    counts.maintain_counts(twice, folder, checkpoint, availableNow=True).awaitTermination()
    return counts.read_counts(spark, folder)


# Day folders


def _delivered(spark: SparkSession, sf_dir: str) -> str:
    """The readings in day folders and their summary; those with an odd minute come later.

    The late ones fall on days that are already there and summarised.
    """
    root = fresh_path(spark, "lake")
    readings = testdata.load(spark, sf_dir).readings
    odd = F.minute("date") % 2 == 1
    days.deliver(readings.where(~odd), root, "readings")
    day_summary.refresh(spark, root)
    days.deliver(readings.where(odd), root, "readings", replace=False)
    day_summary.refresh(spark, root)
    return root


@session_query
def q_flood_status_days(spark, sf_dir):
    """The flood status from the summary and the days of the newest readings."""
    return day_summary.flood_status(spark, _delivered(spark, sf_dir), AS_OF)


@session_query
def q_top3_days(spark, sf_dir):
    top = day_summary.top_readings(spark, _delivered(spark, sf_dir))
    return top.select("sensor_ID", "date", "rnk")


@session_query
def q_redelivered_days(spark, sf_dir):
    """Days delivered again replace themselves only; a range then reads its own days.

    The second delivery holds the days from the middle on, with the voltage a tenth higher.
    """
    root = fresh_path(spark, "lake")
    readings = testdata.load(spark, sf_dir).readings
    days.deliver(readings, root, "readings")
    better = readings.where(F.col("date") >= MIDDLE)
    days.deliver(better.withColumn("voltage", F.round(F.col("voltage") + 0.1, 2)), root, "readings")
    kept = series.sensor_series(days.read_days(spark, root, "readings"), "2024-01-14", "2024-01-20")
    return kept.select("sensor_ID", "date", F.round("voltage", 2).alias("voltage"))


@session_query
def q_timeline_days(spark, sf_dir):
    """The status timeline after three appended stretches."""
    readings = testdata.load(spark, sf_dir).readings
    store = timeline_store.TimelineStore(spark, fresh_path(spark, "timeline"))
    begin = None
    for end in ("2024-01-12", "2024-01-24", "2024-03-01"):
        part = readings.where(F.col("date") < end)
        store.append(part if begin is None else part.where(F.col("date") >= begin), end)
        begin = end
    return store.read()
