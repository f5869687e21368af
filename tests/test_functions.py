from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gaugelake.functions import clock, text


@pytest.mark.parametrize(
    "minutes, words",
    [
        (-1, "<strong>-1</strong> minutes ago"),
        (0, "<strong>0</strong> minutes ago"),
        (59, "<strong>59</strong> minutes ago"),
        (60, "about <strong>1</strong> hour(s) ago"),
        (90, "about <strong>2</strong> hour(s) ago"),
        (150, "about <strong>2</strong> hour(s) ago"),
        (210, "about <strong>4</strong> hour(s) ago"),
        (1439, "about <strong>24</strong> hour(s) ago"),
        (1440, "about <strong>1</strong> day(s) ago"),
        (3600, "about <strong>2</strong> day(s) ago"),
    ],
)
def test_age_text(value, minutes, words):
    assert value(clock.age_text(F.lit(minutes))) == words


@pytest.mark.parametrize(
    "date, age",
    [
        ("2024-01-30 12:00:00", 0),
        ("2024-01-30 12:00:01", -1),
        ("2024-01-30 11:19:00.000001", 40),
        ("2024-01-30 11:19:00", 41),
        ("2024-01-30 09:00:00", 180),
        ("2024-01-30 09:00:00.000001", 179),
    ],
)
def test_age_is_floored(value, date, age):
    assert value(clock.age_minutes("2024-01-30 12:00:00", clock.instant(date))) == age


def test_instant_reads_naive_and_zoned_moments_alike(value):
    naive = datetime(2024, 1, 30, 12, 0, 0, 250000)
    zoned = datetime(2024, 1, 30, 7, 0, 0, 250000, timezone(timedelta(hours=-5)))
    micros = [value(F.unix_micros(clock.instant(m))) for m in (naive, zoned, "2024-01-30 12:00:00.25")]
    assert len(set(micros)) == 1


@pytest.mark.parametrize(
    "date, hour",
    [("2024-01-10", 5), ("2024-07-10", 4), ("2024-03-10", 5), ("2024-03-11", 4), ("2024-11-03", 4), ("2024-11-04", 5)],
)
def test_local_midnight_follows_daylight_time(value, date, hour):
    assert value(F.hour(clock.local_midnight(date))) == hour


@pytest.mark.parametrize(
    "date, words",
    [
        ("2024-01-30 05:05:00", "12:05 AM EST - Jan 30, 2024"),
        ("2024-07-04 17:30:00", "01:30 PM EDT - Jul 04, 2024"),
        ("2024-11-03 05:30:00", "01:30 AM EDT - Nov 03, 2024"),
        ("2024-11-03 06:30:00", "01:30 AM EST - Nov 03, 2024"),
    ],
)
def test_clock_text(value, date, words):
    assert value(clock.clock_text(clock.instant(date))) == words


def test_clock_text_without_instant(value):
    assert value(clock.clock_text(F.lit(None).cast("timestamp"))) == "NA - NA"


def test_epoch_ms(value):
    assert value(clock.epoch_ms(clock.instant("1970-01-01 00:00:01.5"))) == 1500


@pytest.mark.parametrize(
    "number, words",
    [(3.0, "3"), (-0.001, "0"), (3.14159, "3.14"), (-2.5, "-2.5"), (0.07, "0.07"), (None, None)],
)
def test_number_text(value, number, words):
    assert value(text.number_text(F.lit(number).cast("double"), 2)) == words


def test_glue_writes_missing_values(value):
    assert value(text.glue("a", F.lit(None).cast("string"), F.lit(2))) == "aNA2"


def test_drop_first_leaves_later_matches(value):
    assert value(text.drop_first(F.lit("CAM_X_CAM_1"), "CAM_")) == "X_CAM_1"
    assert value(text.drop_first(F.lit("a\nCAM_b"), "CAM_")) == "a\nb"
    assert value(text.drop_first(F.lit("none"), "CAM_")) == "none"


def test_list_and_sentinel_predicates(value):
    assert value(text.has_item(F.split(F.lit("obs, pred"), ", "), "pred")) is True
    assert value(text.has_item(F.lit(None).cast("array<string>"), "obs")) is False
    assert value(text.filled(F.lit(""))) is False
    assert value(text.filled(F.lit(None).cast("string"))) is False
    assert value(text.filled(F.lit("u"))) is True
