"""Bounded, deterministic samples of labelled rows for the models fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def labelled_sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``label_id, y`` of at most ``limit`` labelled ids outside fold 0, in the order of a hash of the id.

    Null ids and labels other than 0 and 1 are left out; an id with several labels counts as 1 if any is.
    ``limit`` bounds the result, so it may be broadcast."""
    own = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("y"))
    own = own.where("label_id IS NOT NULL AND y IN (0, 1)").where(fold("label_id") != 0)
    return own.groupBy("label_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("label_id"), "label_id").limit(limit)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``label_id, y, text``: one text for each id of the sample, so no more rows than it has.

    Of several rows of an id the one with the smallest hash of its text is taken."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    return own.groupBy("label_id").agg(F.max("y").alias("y"), F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
