"""Keep-one-per-key operators; ties are always settled by a named column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is smallest by ``order``.

    An ordered minimum over a struct: partial on the map side, so a hot key sends one row a task."""
    rest = [c for c in df.columns if c not in keys]
    lead = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)]).alias("_o")
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), lead).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def keep_latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Greatest ``time`` of each key; equal times keep the smaller ``tie``."""
    return keep_one(df, keys, [-F.unix_micros(F.col(time).cast("timestamp")), F.col(tie)])


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return keep_one(df, keys, [F.col(order)])
