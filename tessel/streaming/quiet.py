"""The last value of each burst over a stream, a burst ending with a pause.

``after_quiet`` keeps bursts as session windows, which Spark merges and frees by the watermark, so a row costs no call into
Python. ``after_quiet_by_timers`` tells the same by state with timers; it calls the state store several times a burst, so it is for
streams whose rows need Python anyway. State of a key is then the bursts that are still open (start, end, tie, value, in microseconds of event time), a handful, as the
watermark bounds how late rows may come. A row joins, and may link, the bursts within a pause of it. A timer for each burst
fires when the watermark has passed its end by a pause: no row can join it any more, its last value is
told once, and its state and timers are freed. Rows that are later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

# Spark also loads the processor in a Python of its own beside the driver, which doesn't know this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Burst = tuple[int, int, int, int]
#: Fixed value: the store that state with timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_row(bursts: list[Burst], at: int, tie: int, value: int, pause: int) -> list[Burst]:
    """``bursts`` after a row at a time: those no more than a pause from it become one."""
    near = [b for b in bursts if b[0] - pause <= at <= b[1] + pause]
    last = max([(b[1], b[2], b[3]) for b in near] + [(at, tie, value)])
    start = min([b[0] for b in near] + [at])
    return sorted([b for b in bursts if b not in near] + [(start, *last)])


class Bursts(StatefulProcessor):
    def __init__(self, key: str, pause: int):
        self.key, self.pause = key, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField(n, LongType()) for n in ("start", "end", "tie", "value")]
        self.open = handle.getListState("open", StructType(fields))

    def _due(self, burst: Burst) -> int:
        """Milliseconds from which on no row can join it."""
        return (burst[1] + self.pause) // 1000 + 1

    def _kept(self) -> list[Burst]:
        return [tuple(map(int, b)) for b in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self._kept()
        bursts = before
        for pdf in rows:
            for at, tie, value in zip(pdf["at"].tolist(), pdf["tie"].tolist(), pdf["value"].tolist()):
                bursts = with_row(bursts, at, tie, value, self.pause)
        old, new = {self._due(b) for b in before}, {self._due(b) for b in bursts}
        for due in old - new:
            self.handle.deleteTimer(due)
        for due in new - old:
            self.handle.registerTimer(due)
        self.open.put(bursts)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        kept = self._kept()
        done, left = [b for b in kept if self._due(b) <= due], [b for b in kept if self._due(b) > due]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        yield pd.DataFrame({self.key: [key[0]] * len(done), "value": [b[3] for b in done], "at": [b[1] for b in done]})

    def close(self) -> None:
        pass


def marked(events: DataFrame, key: str, ts: str, tie: str, value: str, late: str) -> DataFrame:
    """(key, _ts, tie, value, at) of the rows without a null, with a watermark."""
    named = {"tie": tie, "value": value}
    rows = events.select(F.col(key).cast("bigint").alias(key), F.col(ts).cast("timestamp").alias("_ts"), *(F.col(c).cast("bigint").alias(n) for n, c in named.items()))
    return rows.dropna().withWatermark("_ts", late).withColumn("at", F.unix_micros("_ts"))


def after_quiet(events: DataFrame, key: str, ts: str, tie: str, value: str, pause: str, late: str) -> DataFrame:
    """(key, value, at): the last value of each burst of a stream, told when a pause has passed. ``key``, ``tie`` and ``value``
    are bigints; ``late``: how far behind the latest row a row may come. Rows with a null in one of these are left out."""
    bursts = marked(events, key, ts, tie, value, late).groupBy(key, F.session_window("_ts", pause).alias("_burst"))
    return bursts.agg(F.max(F.struct("at", "tie", "value")).alias("_last")).select(key, "_last.value", "_last.at")


def after_quiet_by_timers(events: DataFrame, key: str, ts: str, tie: str, value: str, pause: str, late: str) -> DataFrame:
    """As ``after_quiet``, by state with timers; the session's state store must be RocksDB (``with_timers``)."""
    spark = events.sparkSession
    micros = spark.sql(f"SELECT CAST(unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {pause}) AS BIGINT)").first()[0]
    rows = marked(events, key, ts, tie, value, late)
    out = f"{key} bigint, value bigint, at bigint"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Bursts(key, micros), outputStructType=out, outputMode="Append", timeMode="EventTime")


class with_timers:
    """Within this the session keeps state in RocksDB; what it kept state in before comes back."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self) -> None:
        self.old = self.spark.conf.get(self.name)
        self.spark.conf.set(self.name, ROCKS)

    def __exit__(self, *failure) -> None:
        self.spark.conf.set(self.name, self.old)
