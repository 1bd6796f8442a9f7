"""Verdict files as a stream: running rates, and the latest row of a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import schemas


def read_verdicts(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New verdict files (JSON arrays) below ``folder`` as a stream; files of zero bytes bring no row."""
    reader = spark.readStream.schema(schemas.VERDICTS).option("multiLine", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def running_success(verdicts: DataFrame) -> DataFrame:
    """``id, n, ok``: verdicts of each id so far and whether one succeeded; state is one row for each id."""
    return verdicts.groupBy("id").agg(F.count("*").alias("n"), F.max(F.col("verdict.status") == "success").alias("ok"))


def windowed_verdicts(verdicts: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, status, n`` of event-time windows; rows later than ``late`` are dropped with their state."""
    rows = verdicts.withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), F.col("verdict.status").alias("status")).agg(F.count("*").alias("n")).select("w.start", "status", "n")


def keep_latest(rows: DataFrame, key: str, time: str, order: str, payload: str) -> DataFrame:
    """``key, time, order, payload`` whenever a key gets a newer row (greater time; of equal times the smaller order).

    State is one row for each key. ``key`` and ``payload`` are strings, ``time`` and ``order`` longs."""
    schema = f"{key} string, {time} long, {order} long, {payload} string"

    def update(group: tuple, frames: Iterator[pd.DataFrame], state):
        held = state.get if state.exists else None
        best = held
        for frame in frames:
            for t, o, p in zip(frame[time], frame[order], frame[payload], strict=True):
                if best is None or (t, -o) > (best[0], -best[1]):
                    best = (int(t), int(o), p)
        if best != held:
            state.update(best)
            yield pd.DataFrame({key: [group[0]], time: [best[0]], order: [best[1]], payload: [best[2]]})

    own = rows.select(key, time, order, payload)
    return own.groupBy(key).applyInPandasWithState(update, schema, "t long, o long, p string", "update", "NoTimeout")
