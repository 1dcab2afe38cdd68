"""Rows that end a quiet time: stateful, with timers that forget a value once it has been quiet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class AfterQuiet(StatefulProcessor):
    """Keeps the last time of each value, and a timer at the end of its quiet time, which drops it.

    Times are microseconds of the epoch (``us``): neither a time zone's changes nor rounding move a gap.
    """

    def __init__(self, quiet_us: int):
        self.quiet_us = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def _timer(self, last: int) -> int:
        """The first whole millisecond at which the value has been quiet."""
        return -(-(last + self.quiet_us) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The batch's rows of a value in the order of their times; only times are held."""
        us = np.sort(np.concatenate([r["us"].to_numpy(np.int64) for r in rows]))
        held = self.last.get()[0] if self.last.exists() else None
        before = np.append(held if held is not None else us[0] - self.quiet_us, us[:-1])
        starts = us[us - before >= self.quiet_us]
        newest = int(us[-1]) if held is None else max(int(us[-1]), held)
        if held is not None:
            self.handle.deleteTimer(self._timer(held))
        self.last.update((newest,))
        self.handle.registerTimer(self._timer(newest))
        yield pd.DataFrame({"value": pd.Series([str(key[0])] * len(starts), dtype=object), "us": starts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_timers(spark: SparkSession) -> None:
    """Streams that start from now on keep their state where timers are possible."""
    spark.conf.set(*STORE)


def after_quiet(stream: DataFrame, value: str, time: str, quiet_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """(value, since): the rows before which their value had no row for ``quiet_ms``, its first row among them.

    A value's state is one time, and goes when the watermark passes its quiet time: what is kept grows
    with the values that are in use, not with those ever seen. Rows behind the watermark are left
    out. Needs ``with_timers`` before the stream starts. A null value is a value, as ``None``.
    """
    rows = stream.withWatermark(time, lateness).select(F.col(value).cast("string").alias("value"), time, F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    found = rows.groupBy("value").transformWithStateInPandas(AfterQuiet(quiet_ms * 1000), "value string, us long", "Append", "EventTime")
    return found.select("value", F.timestamp_micros("us").alias("since"))
