"""Time the headline queries on whole tables and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores. Each query is
run once to warm up and then timed; its result is computed in full and thrown away.
"""

import json
import os
import sys
import time

from gaugelake.plans.catalog import QUERIES
from gaugelake.session import build_session

HEADLINE = [
    "q_flood_status",
    "q_status_timeline",
    "q_top3",
    "q_latest_survey",
    "q_sensor_map",
    "q_camera_map",
    "q_sensor_series",
    "q_blank_dry",
    "q_gap_segments",
    "q_line_points",
    "q_axis_bounds",
    "q_download",
    "q_thirdparty_union",
    "q_overlay_obs",
    "q_chart_series",
    "q_chart_series_admin",
    "q_tide_json_obs",
    "q_sensor_health",
    "q_camera_health",
    "q_place_panel",
    "q_deeplink",
    "q_stream_changes",
    "q_flood_status_days",
    "q_top3_days",
    "q_timeline_days",
]


def run(spark, name, sf_dir):
    begun = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    spark = build_session("bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(run(spark, name, sf_dir), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
