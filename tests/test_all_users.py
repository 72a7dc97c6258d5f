"""Averages over every user; M5's constraint on the group column."""

import datetime as dt

from loomgraph import catalog
from loomgraph.operators import timeseries


def test_averages_leave_no_user_out(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(at, 1, 2.0), (at, 1, 4.0), (at, 900, 5.0)], "ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: r.value for r in catalog.event_averages_all(spark, str(tmp_path)).collect()} == {1: 3.0, 900: 5.0}
    e = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert [r.user_id for r in timeseries.average_by(e, "ts", "user_id", ["value"], [("user_id", "<", 500)]).collect()] == [1]
