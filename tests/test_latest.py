from pyspark.sql import functions as F

from gaugelake.operators import latest

T = "k STRING, t TIMESTAMP, v INT"


def at(minute):
    return f"2024-01-01 00:{minute:02d}:00"


def test_ties_and_missing_keys_are_kept(frame):
    rows = [dict(k="a", t=at(1), v=1), dict(k="a", t=at(2), v=2), dict(k="a", t=at(2), v=3),
            dict(k="b", t=at(9), v=4), dict(k=None, t=at(3), v=5), dict(k="c", t=None, v=6)]
    got = latest.newest_rows(frame(T, rows), ["k"], "t").collect()
    assert sorted((r["k"] or "", r["v"]) for r in got) == [("", 5), ("a", 2), ("a", 3), ("b", 4)]


def test_ranks_keep_ties(frame):
    minutes = [5, 4, 4, 4, 3, 9]
    rows = [dict(k="a", t=at(m), v=i) for i, m in enumerate(minutes)] + [dict(k="b", t=at(1), v=0)]
    got = latest.newest_ranked(frame(T, rows), ["k"], "t", 3).collect()
    assert sorted((r["k"], r["t"].minute, r["rnk"]) for r in got) == [
        ("a", 4, 3), ("a", 4, 3), ("a", 4, 3), ("a", 5, 2), ("a", 9, 1), ("b", 1, 1),
    ]


def test_very_many_copies_of_the_newest_row(frame):
    rows = [dict(k="hot", t=at(8), v=1)] * 3000 + [dict(k=f"k{i}", t=at(i % 60), v=i) for i in range(200)]
    df = frame(T, rows)
    assert latest.newest_rows(df, ["k"], "t").count() == 3200
    assert latest.newest_ranked(df, ["k"], "t", 3).where("k = 'hot' AND rnk = 1").count() == 3000


def test_shuffled_join_gives_the_same(spark, frame):
    rows = [dict(k=f"k{i % 50}", t=at(i % 60), v=i) for i in range(2000)]
    df = frame(T, rows)
    small = sorted(map(tuple, latest.newest_rows(df, ["k"], "t").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = latest.newest_rows(df, ["k"], "t")
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert sorted(map(tuple, result.collect())) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_restricting_before_or_after_is_the_same(frame):
    rows = [dict(k=f"k{i % 7}", t=at(i * 13 % 60), v=i) for i in range(300)]
    df = frame(T, rows)
    before = latest.newest_rows(df.where("k = 'k3'"), ["k"], "t").collect()
    after = latest.newest_rows(df, ["k"], "t").where("k = 'k3'").collect()
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))


def test_one_per_key_takes_the_smallest_row(frame):
    rows = [dict(k="a", t=at(2), v=1), dict(k="a", t=at(1), v=9), dict(k="b", t=at(1), v=None)]
    got = latest.one_per_key(frame(T, rows), ["k"]).orderBy("k").collect()
    assert [(r["k"], r["v"]) for r in got] == [("a", 9), ("b", None)]


def test_sample_interval(frame):
    rows = [dict(k="a", t=at(m)) for m in (1, 7, 20)] + [dict(k="b", t=at(5))]
    rows += [dict(k="c", t=at(m)) for m in (5, 5, 9)]
    df = frame(T, rows).select(F.col("k").alias("sensor_ID"), F.col("t").alias("date"))
    top = latest.newest_ranked(df, ["sensor_ID"], "date", 3)
    got = {r["sensor_ID"]: r["min_interval"] for r in latest.sample_interval(top).collect()}
    assert got == {"a": 6.0, "b": None, "c": 0.0}


def test_lookback_bound_is_exclusive_and_coordinates_are_needed(frame):
    schema = (
        "sensor_ID STRING, date TIMESTAMP, lat DOUBLE, lng DOUBLE, sensor_water_level DOUBLE, "
        "road_water_level DOUBLE, sensor_water_level_adj DOUBLE, road_water_level_adj DOUBLE"
    )
    rows = [
        dict(sensor_ID="old", date="2024-01-01 00:00:00", lat=1.0, lng=1.0),
        dict(sensor_ID="new", date="2024-01-01 00:00:01", lat=1.0, lng=1.0, road_water_level_adj=2.0, road_water_level=7.0),
        dict(sensor_ID="nowhere", date="2024-02-01 00:00:00", lat=None, lng=1.0),
    ]
    rows.append(dict(sensor_ID="new", date="2023-06-01 00:00:00", lat=1.0, lng=1.0))
    df, now = frame(schema, rows), "2024-03-31 08:00:00"
    known = latest.newest_rows(df, ["sensor_ID"], "date")
    for result in (latest.latest_sensors(df, now, 90), latest.recent_sensors(known, now, 90)):
        assert [(r["sensor_ID"], r["road_water_level"]) for r in result.collect()] == [("new", 2.0)]


def test_empty_input(frame):
    df = frame(T, [])
    assert latest.newest_rows(df, ["k"], "t").count() == 0
    assert latest.newest_ranked(df, ["k"], "t", 3).count() == 0
