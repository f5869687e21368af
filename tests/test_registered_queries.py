"""Every registered query equals its SQL on the same tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest
from data import DATA

import __spark_entry__ as entry_file
from gaugelake.plans.catalog import QUERIES

FOLDER = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def in_order(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    result = entry_file.queries()[name](spark, FOLDER)
    columns = sorted(result.columns)
    ours = in_order(tuple(row[c] for c in columns) for row in result.collect())
    answer = duck.execute(entry_file.oracle_sql()[name])
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == columns
    places = [theirs.index(c) for c in columns]
    assert ours == in_order(tuple(row[p] for p in places) for row in answer.fetchall())
    assert ours


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_file.oracle_sql())
    assert set(QUERIES) <= set(entry_file.queries())


def test_entry_runs(spark):
    df = entry_file.entry(spark)
    assert df.columns == [
        "sensor_ID", "time_since_measurement", "time_since_measurement_text", "flood_status",
    ]
    assert df.count() == 15
