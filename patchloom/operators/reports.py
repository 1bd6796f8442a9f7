"""Counting operators: histograms with shares, rates, cascades and group filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, half up at ``digits``; written out so that every engine rounds alike."""
    scale = 10.0**digits
    return F.floor(100.0 * scale * part / whole + 0.5) / scale


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """``value, n, pct``; shares are of all rows, also when the null bucket is left out.

    The total is a scalar over the aggregated counts, so no task has to hold all values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    out = counts.withColumn("pct", share(F.col("n"), df.agg(F.count("*")).scalar()))
    return out if keep_null else out.where("value IS NOT NULL")


def plausible_rate(df: DataFrame, key: str, success: Column) -> DataFrame:
    """One row ``n_ids, n_success, rate``: share of ids with at least one success, -1 for no id."""
    ids = df.groupBy(key).agg(F.max(F.coalesce(success, F.lit(False)).cast("int")).alias("ok"))
    total = ids.agg(F.count("*").alias("n_ids"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_success"))
    return total.withColumn("rate", F.when(F.col("n_ids") == 0, F.lit(-1.0)).otherwise(share(F.col("n_success"), F.nullif(F.col("n_ids"), F.lit(0)))))


def having(df: DataFrame, keys: list[str], condition: Column, **aggs: Column) -> DataFrame:
    """Rows of the groups whose aggregates satisfy ``condition`` (joined back, so no group is gathered)."""
    groups = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]).where(condition).select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = None
    for k in keys:
        on = F.col(k).eqNullSafe(F.col(f"_{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(groups, on, "left_semi")


def filter_cascade(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """``step_no, step, removed, remaining`` of filters applied in turn, in one pass over the rows."""
    failed = F.lit(len(steps))
    for i, (_, keep) in reversed(list(enumerate(steps))):
        failed = F.when(~F.coalesce(keep, F.lit(False)), F.lit(i)).otherwise(failed)
    counts = df.groupBy(failed.alias("step_no")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step")) for i, (n, _) in enumerate(steps)])
    listed = df.sparkSession.range(1).select(F.inline(names))
    joined = listed.join(counts, "step_no", "left").select("step_no", "step", F.coalesce("n", F.lit(0)).alias("removed"))
    total = df.agg(F.count("*")).scalar()
    running = F.sum("removed").over(Window.partitionBy(F.lit(1)).orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("remaining", total - running).select(F.col("step_no").cast("long").alias("step_no"), "step", F.col("removed").cast("long").alias("removed"), F.col("remaining").cast("long").alias("remaining"))


def classify(df: DataFrame, cases: list[tuple[str, Column]], default: str, name: str = "reason") -> DataFrame:
    """Histogram of the first case each row satisfies."""
    value = F.lit(default)
    for label, when in reversed(cases):
        value = F.when(when, F.lit(label)).otherwise(value)
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def until_stopped(epochs: DataFrame, epoch: str, loss: str, patience: int) -> DataFrame:
    """``epoch, loss, best`` up to the first epoch that is ``patience`` or more after the best so far (least loss, then earliest).

    One row an epoch, so a window over all of them is small."""
    order = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e"))).over(order)["e"]
    known = epochs.select(epoch, loss, best.alias("best"))
    late = F.max((F.col(epoch) - F.col("best") >= patience).cast("int")).over(Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    return known.withColumn("_late", late).where(F.coalesce("_late", F.lit(0)) == 0).drop("_late")


def total_and_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, total, mean`` of a measured value, rows without it counted."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    return found.withColumn("mean", F.col("total") / F.col("n"))
