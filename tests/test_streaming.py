"""Streams against windows over the whole table."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming.rolling import replay, rolling_mean

DDL = "event_id long, user_id long, ts timestamp, x long"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def write(spark, path, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path, size=2):
    stream = rolling_mean(spark.readStream.schema(DDL).parquet(str(tmp_path / "in")), "user_id", "ts", "event_id", "x", size)
    out = replay(stream, "t", str(tmp_path / "state"), str(tmp_path / "out"))
    return {r.event_id: (r.late, r.n, r.total) for r in out.collect()}


def test_resumed_stream_goes_on_from_its_state_and_late_rows_are_not_applied(spark, tmp_path):
    write(spark, tmp_path / "in", [(1, 7, at(1), 10), (2, 7, at(2), None), (3, 8, at(2), 5)])
    first = run(spark, tmp_path)
    assert first == {1: (False, 1, 10), 2: (False, 1, 10), 3: (False, 1, 5)}
    write(spark, tmp_path / "in", [(4, 7, at(3), 30), (5, 7, at(1), 99), (6, 7, at(4), 40)])
    second = run(spark, tmp_path)
    assert second == first | {4: (False, 1, 30), 5: (True, None, None), 6: (False, 2, 70)}
    assert run(spark, tmp_path) == second  # nothing new: nothing repeated


def test_one_value_windows(spark, tmp_path):
    write(spark, tmp_path / "in", [(1, 7, at(1), 10), (2, 7, at(2), 20)])
    assert run(spark, tmp_path, 1) == {1: (False, 1, 10), 2: (False, 1, 20)}
