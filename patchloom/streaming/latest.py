"""The latest row of a key as a stream with bounded state: what the watermark has passed is forgotten.

A row that is not late is never older than the watermark. So once the watermark has passed the latest row of a key, the next
row of that key is newer in any case and the held one need not be compared again: a timer drops it. The state is one row for
each key seen within the allowed lateness, however many keys the stream has had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that processors with timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_state_store(spark: SparkSession) -> None:
    """Name the store for streams that are started from now on."""
    spark.conf.set(*STORE)


class LatestRow(StatefulProcessor):
    """Holds (microseconds, order, payload) of a key's latest row until the watermark has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("latest", "t long, o long, p string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        best = held
        for frame in rows:
            for t, o, p in zip(frame["micros"].tolist(), frame["ord"].tolist(), frame["payload"].tolist(), strict=True):
                if best is None or (t, -o) > (best[0], -best[1]):
                    best = (int(t), int(o), p)
        if best != held:
            self.held.update(best)
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(best[0] // 1000 + 1)
            yield self._row(key, best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def _row(self, key, best) -> pd.DataFrame:
        return pd.DataFrame({name: [value] for name, value in zip(("key", "micros", "ord", "payload"), (key[0], *best), strict=True)})

    def close(self) -> None:
        pass


def latest_rows(rows: DataFrame, key: str, time: str, order: str, payload: str, late: str = "2 hours") -> DataFrame:
    """``key, time, order, payload`` whenever a key gets a newer row: greater ``time``, of equal times the smaller ``order``.

    ``time`` is a timestamp and ``order`` a long; ``key`` and ``payload`` are strings. The last row given for a key is its
    latest, for any cut of the stream into batches and any number of restarts, over all rows that are not later than
    ``late``. Rows without a key, time or order are left out; a null payload stays null; a repeated row changes nothing."""
    own = rows.select(F.col(key).alias("key"), F.col(time).alias("at"), F.col(order).alias("ord"), F.col(payload).alias("payload"))
    sent = own.dropna(subset=["key", "at", "ord"]).withWatermark("at", late).withColumn("micros", F.unix_micros("at")).groupBy("key")
    out = sent.transformWithStateInPandas(LatestRow(), "key string, micros long, ord long, payload string", "Update", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("micros").alias(time), F.col("ord").alias(order), F.col("payload").alias(payload))
