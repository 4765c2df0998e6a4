"""Times between whole seconds fall into the days and slots that the SQL puts them in."""

import datetime

import duckdb
import pytest

from wrenlake import plans


def events(spark, folder, times):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=s), u, t, float(v)) for i, (s, u, t, v) in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize(
    ("name", "times"),
    [
        ("early_stop", [(86399.2, 1, "view", 1), (86399.5, 1, "view", 9), (86399.7, 1, "view", 5), (86400.0, 1, "view", 2), (9 * 86400.0 - 0.4, 1, "view", 3), (3.5, 1, "view", 4)]),
        ("pseudo_round1", [(4.9, 1, "click", 0), (5.0, 1, "view", 0), (5.1, 1, "view", 0), (9.9, 1, "view", 0), (15.0, 2, "click", 0), (24.9, 2, "view", 0), (25.0, 2, "view", 0), (14.9, 2, "view", 0)]),
    ],
)
def test_between_seconds(spark, tmp_path, name, times):
    events(spark, tmp_path, times)
    df = plans.QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    found = db.execute(plans.SQL[name])
    at = [[x[0] for x in found.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
