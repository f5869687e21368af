import random
from datetime import datetime, timedelta

import pytest

from gaugelake.operators import segments

S = "sensor_ID STRING, date TIMESTAMP, wl DOUBLE"
T0 = datetime(2024, 1, 10)


def at(seconds):
    return str(T0 + timedelta(seconds=seconds))


def runs(frame, points, **how):
    df = frame(S, [dict(sensor_ID="A", date=at(t), wl=v) for t, v in points])
    got = segments.gap_segments(df, **how).orderBy("segment").collect()
    return [(r["segment"], (r["start"] - T0).seconds, (r["end"] - T0).seconds, r["n"]) for r in got]


def test_gap_of_exactly_the_limit_does_not_break(frame):
    assert runs(frame, [(0, 1.0), (2160, 1.0)]) == [(1, 0, 2160, 2)]
    assert runs(frame, [(0, 1.0), (2161, 1.0)]) == [(1, 0, 0, 1), (2, 2161, 2161, 1)]


def test_blank_readings_break_and_belong_to_no_segment(frame):
    points = [(0, None), (60, 1.0), (120, None), (180, 1.0), (240, 2.0), (300, None)]
    assert runs(frame, points) == [(1, 60, 60, 1), (2, 180, 240, 2)]


def test_blank_reading_at_the_same_instant_comes_first(frame):
    points = [(0, 1.0), (60, 1.0), (60, None), (120, 1.0)]
    assert runs(frame, points) == [(1, 0, 0, 1), (2, 60, 120, 2)]


def brute(points):
    """Walk over the sorted readings of one sensor."""
    out, prev = [], None
    for t, v in sorted(points, key=lambda p: (p[0], p[1] is not None)):
        if v is not None:
            if prev is None or prev[1] is None or t - prev[0] > 2160:
                out.append([t, t, 0])
            out[-1][1] = t
            out[-1][2] += 1
        prev = (t, v)
    return [(i + 1, *run) for i, run in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("bucket", [300, 3600, 10**7])
def test_equals_a_walk_for_any_bucket(frame, seed, bucket):
    rng = random.Random(seed)
    points = [(rng.randrange(0, 80000, 20), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(150)]
    assert runs(frame, points, seconds=bucket) == brute(points)


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_every_drawn_reading_is_in_one_segment(frame, hot_rows):
    rng = random.Random(5)
    points = [(rng.randrange(80000), rng.choice([None, 1.0])) for _ in range(200)]
    points += [(500, 1.0)] * 40 + [(700, None)] * 5
    df = frame(S, [dict(sensor_ID=s, date=at(t), wl=v) for s in "AB" for t, v in points])
    drawn = sum(v is not None for _, v in points)
    table = segments.gap_segments(df)
    assert sum(r["n"] for r in table.collect()) == 2 * drawn
    labelled = segments.with_segments(df, hot_rows=hot_rows)
    assert labelled.count() == 2 * len(points)
    assert labelled.where("(segment IS NULL) <> (wl IS NULL)").count() == 0
    counted = {(r["sensor_ID"], r["segment"]): r["count"] for r in
               labelled.where("segment IS NOT NULL").groupBy("sensor_ID", "segment").count().collect()}
    assert counted == {(r["sensor_ID"], r["segment"]): r["n"] for r in table.collect()}


def test_copies_of_one_reading_are_counted(frame):
    assert runs(frame, [(0, 1.0)] * 500 + [(60, 1.0)]) == [(1, 0, 60, 501)]


def test_empty_series(frame):
    assert runs(frame, []) == []
