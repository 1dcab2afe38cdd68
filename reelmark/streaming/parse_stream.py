"""Streams of release names: parsing, dedupe within a watermark, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.operators.parse import FIELDS, ParserConfig, parse


def parse_stream(stream: DataFrame, column: str = "name", config: ParserConfig = ParserConfig(), made: tuple[str, ...] = FIELDS) -> DataFrame:
    """Records of a stream's names, or their fields ``made``; no state is kept. Blank lines are skipped."""
    return parse(stream.where(F.trim(column) != ""), column, config, made=made)


def first_seen(stream: DataFrame, column: str, time: str, lateness: str = "10 minutes") -> DataFrame:
    """The first row of each value within the watermark, whose state is dropped beyond it."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([column])


def first_in_window(stream: DataFrame, column: str, time: str, width: str = "1 day", lateness: str = "10 minutes") -> DataFrame:
    """(column, start): each value once for each window of its rows' times; the state of a window goes when the watermark passes its end."""
    rows = stream.withWatermark(time, lateness).select(F.col(column), F.window(time, width).alias("window"))
    return rows.dropDuplicates([column, "window"]).select(column, F.col("window.start").alias("start"))


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window, by, n): rows per window and value, tumbling windows or sliding ones; late rows count until the watermark passes a window's end."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, lateness).groupBy(window, by).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, time: str, by: str, gap: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window, by, n): rows per session, which ends when a value has had no row for ``gap``; state is kept for open sessions only."""
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("window"), by).agg(F.count("*").alias("n"))
