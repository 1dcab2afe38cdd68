"""Streams in several batches: late rows, and state that goes when its time is over."""

import datetime as dt
import os

import pytest

from reelmark.streaming import parse_stream, quiet

START = dt.datetime(2024, 1, 1)
#: Hours at which a value was seen, by batch; a file is a batch. Rows are late by the watermark of the batch before.
BATCHES = [[("a", 0), ("b", 0.5), ("a", 1), ("a", 5)], [("a", 5.5), ("c", 6), ("b", 2)], [("b", 30), ("a", 30), (None, 31)], [("f", 33)], [("a", 3), ("d", 60)], [("a", 60.5), ("e", 90)]]


def run(spark, folder, make):
    """The stream's rows over all batches, and the rows of state after each."""
    for n, batch in enumerate(BATCHES):
        frame = spark.createDataFrame([(v, START + dt.timedelta(hours=h)) for v, h in batch], "name string, ts timestamp").coalesce(1)
        frame.write.parquet(f"{folder}/in/{n}")
        for file in sorted(os.listdir(f"{folder}/in/{n}")):  # in the order of their batches
            os.utime(f"{folder}/in/{n}/{file}", (n * 1000 + 10_000, n * 1000 + 10_000))
    stream = spark.readStream.schema("name string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    rows = make(stream)
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    state = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").collect(), state


def hours(moment):
    return (moment - START).total_seconds() / 3600


def test_days_dedupe_forgets_days(spark, tmp_path):
    rows, state = run(spark, str(tmp_path), lambda s: parse_stream.first_in_window(s, "name", "ts"))
    # Late rows of a day that has passed are left out: a at hour 3 comes when the watermark is past day 1.
    assert sorted((str(r["name"]), hours(r["start"])) for r in rows) == [("None", 24.0), ("a", 0.0), ("a", 24.0), ("a", 48.0), ("b", 0.0), ("b", 24.0), ("c", 0.0), ("d", 48.0), ("e", 72.0), ("f", 24.0)]
    assert state[-1] <= 3, state


def test_windows_leave_late_rows_out(spark, tmp_path):
    rows, _ = run(spark, str(tmp_path), lambda s: parse_stream.windowed_counts(s, "ts", "name", "6 hours"))
    got = {(str(r["name"]), hours(r["window"]["start"]), r["n"]) for r in rows}
    assert {("a", 0.0, 4), ("b", 0.0, 2), ("c", 6.0, 1), ("b", 30.0, 1), ("a", 30.0, 1), ("d", 60.0, 1)} <= got, str(sorted(got))
    assert ("a", 0.0, 5) not in got, got


def test_sessions_close_after_their_gap(spark, tmp_path):
    rows, _ = run(spark, str(tmp_path), lambda s: parse_stream.session_counts(s, "ts", "name", "2 hours"))
    got = {(str(r["name"]), hours(r["window"]["start"]), hours(r["window"]["end"]), r["n"]) for r in rows}
    assert {("a", 0.0, 3.0, 2), ("a", 5.0, 7.5, 2), ("c", 6.0, 8.0, 1), ("b", 30.0, 32.0, 1), ("d", 60.0, 62.0, 1)} <= got


def test_quiet_values_are_forgotten(spark, tmp_path):
    quiet.with_timers(spark)
    try:
        rows, state = run(spark, str(tmp_path), lambda s: quiet.after_quiet(s, "name", "ts", 3 * 3_600_000))
    finally:
        spark.conf.unset(quiet.STORE[0])
    got = sorted((r["value"], hours(r["since"])) for r in rows)
    assert got == [("None", 31.0), ("a", 0.0), ("a", 5.0), ("a", 30.0), ("a", 60.5), ("b", 0.5), ("b", 30.0), ("c", 6.0), ("d", 60.0), ("e", 90.0), ("f", 33.0)] or pytest.fail(str(got))
