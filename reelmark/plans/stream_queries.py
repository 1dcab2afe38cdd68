"""Queries of streams over the events, run to their end, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.operators.shared import new_folder
from reelmark.plans.catalogue import _query
from reelmark.streaming import parse_stream, quiet


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(rows: DataFrame, name: str) -> DataFrame:
    """The stream's rows, appended as Parquet beside its state in the shared folder."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, name)
    query = rows.writeStream.format("parquet").option("checkpointLocation", folder + "/state").outputMode("append").trigger(availableNow=True).start(folder + "/rows")
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(folder + "/rows")


def _flat(rows: DataFrame, by: str) -> DataFrame:
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), by, "n")


#: Windows that the watermark has passed are complete, and only those come out.
_PASSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@_query("stream_windows", f"SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_PASSED}")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_run(parse_stream.windowed_counts(_events(spark, sf_dir), "ts", "event_type"), "windows"), "event_type")


@_query(
    "stream_sliding_windows",
    f"""SELECT start, start + INTERVAL 6 HOUR AS stop, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 2 HOUR, ts) - to_hours(CAST(2 * k AS INTEGER)) AS start FROM events, unnest([0, 1, 2]) t(k))
GROUP BY start, event_type HAVING start + INTERVAL 6 HOUR <= {_PASSED}""",
)
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_run(parse_stream.windowed_counts(_events(spark, sf_dir), "ts", "event_type", "6 hours", slide="2 hours"), "sliding"), "event_type")


_SESSIONS = """marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked)"""


@_query("stream_sessions", f"WITH {_SESSIONS}\nSELECT min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS stop, user_id, count(*) AS n FROM numbered GROUP BY user_id, session HAVING max(ts) + INTERVAL 3 HOUR <= {_PASSED}")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_run(parse_stream.session_counts(_events(spark, sf_dir), "ts", "user_id", "3 hours"), "sessions"), "user_id")


@_query("stream_daily_dedupe", "SELECT DISTINCT concat(event_type, ':', user_id) AS name, date_trunc('day', ts) AS start FROM events")
def stream_daily_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value once a day, with a day's state at most."""
    rows = _events(spark, sf_dir).withColumn("name", F.concat_ws(":", "event_type", "user_id"))
    return _run(parse_stream.first_in_window(rows, "name", "ts"), "daily")


@_query("stream_after_quiet", f"WITH {_SESSIONS}\nSELECT CAST(user_id AS VARCHAR) AS value, ts AS since FROM numbered WHERE starts = 1")
def stream_after_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that end three quiet hours of their user."""
    quiet.with_timers(spark)
    try:
        return _run(quiet.after_quiet(_events(spark, sf_dir), "user_id", "ts", 3 * 3_600_000), "quiet")
    finally:
        spark.conf.unset(quiet.STORE[0])
