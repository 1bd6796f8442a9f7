"""Ranking, splitting and budgeted selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.storage import materialize


def global_rank(df: DataFrame, group: str, order: list[Column], name: str = "rn") -> DataFrame:
    """0-based rank of each row inside ``group`` by ``order``, plus the group's size ``n``.

    Rows are dealt by ranges of (group, order), so a group with most of the rows is spread over many
    tasks; each task ranks its range and adds the counts of the ranges before it."""
    dealt = materialize(df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(Window.partitionBy(group)).alias("n"))
    local = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)) - 1
    joined = dealt.withColumn("_local", local).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col("_local") + F.col("_off")).drop("_part", "_g", "_p", "_local", "_off")


def drop_fraction(df: DataFrame, group: str, order: list[Column], fraction: float) -> DataFrame:
    """Positive ``fraction`` f drops the first int(n * (1 - f)) rows of a group, negative the last."""
    drop = F.floor(F.col("n") * F.lit(1 - abs(fraction)))
    ranked = global_rank(df, group, order)
    kept = ranked.where(F.col("rn") >= drop) if fraction > 0 else ranked.where(F.col("rn") < F.col("n") - drop)
    return kept.drop("rn", "n")


def temporal_split(df: DataFrame, project: str, time: str, commit: str, tie: str, ratio: float = 0.8, valid: float = 0.25) -> DataFrame:
    """Adds ``split``: train up to a commit boundary near ``ratio``; later commits go to valid and test.

    Boundaries are found on commits, not rows: one aggregated row for each commit is ordered inside its
    project. A project with a single commit is all train."""
    commits = df.groupBy(project, time, commit).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(project).orderBy(time, commit)
    commits = commits.withColumn("_at", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy(project)
    size = F.floor(F.lit(ratio) * F.sum("_n").over(whole))
    commits = commits.withColumn("_size", size)
    low = F.max(F.when((F.col("_at") > 0) & (F.col("_at") <= F.col("_size") - 1), F.col("_at"))).over(whole)
    least = F.min(F.when(F.col("_at") > 0, F.col("_at"))).over(whole)
    commits = commits.withColumn("_cut", F.coalesce(low, least)).select(F.col(project).alias("_p"), F.col(time).alias("_t"), F.col(commit).alias("_k"), "_n", (F.col("_cut").isNull() | (F.col("_at") < F.col("_cut"))).alias("_train"))
    joined = df.join(commits, F.col(project).eqNullSafe(F.col("_p")) & F.col(time).eqNullSafe(F.col("_t")) & F.col(commit).eqNullSafe(F.col("_k")))
    place = F.row_number().over(Window.partitionBy(project, time, commit).orderBy(tie)) - 1
    split = F.when(F.col("_train"), "train").when(place < F.floor(F.lit(valid) * F.col("_n")), "valid").otherwise("test")
    return joined.withColumn("split", split).drop("_p", "_t", "_k", "_n", "_train")


def merge_not_newer(rows: DataFrame, reference: DataFrame, key: str, time: str) -> DataFrame:
    """``rows`` that are not newer than the greatest ``time`` of their key in ``reference``; no key, no row."""
    latest = reference.groupBy(F.col(key).alias("_k")).agg(F.max(time).alias("_latest"))
    return rows.join(latest, F.col(key) == F.col("_k")).where(F.col(time) <= F.col("_latest")).drop("_k", "_latest")


def tfidf_cosine(tokens: DataFrame, group: str, doc: str, target, token: str = "token") -> DataFrame:
    """``group, doc, similarity`` of every document with the target document of its own group.

    The corpus is the group itself: idf = ln((1 + n) / (1 + df)) + 1, raw counts, cosine. Keys are
    (group, token) throughout, so a common word of one group meets nothing of another."""
    counts = tokens.groupBy(group, doc, token).agg(F.count("*").alias("tf"))
    goal = F.col(doc) == target
    sizes = tokens.select(group, doc).distinct().groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n_docs"))
    terms = counts.groupBy(F.col(group).alias("_tg"), F.col(token).alias("_tt")).agg(F.count("*").alias("df"), F.max(F.when(goal, F.col("tf"))).alias("tf0"))
    known = terms.join(sizes, F.col("_tg") == F.col("_g")).select("_tg", "_tt", "tf0", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    own = F.coalesce("tf0", F.lit(0)) * F.col("idf")
    lengths = known.groupBy(F.col("_tg").alias("_ng")).agg(F.sqrt(F.sum(own * own)).alias("norm0"))
    weight = F.col("tf") * F.col("idf")
    joined = counts.join(known, (F.col(group) == F.col("_tg")) & (F.col(token) == F.col("_tt")))
    docs = joined.groupBy(group, doc).agg(F.sqrt(F.sum(weight * weight)).alias("norm"), F.sum(weight * own).alias("dot"))
    scored = docs.where(F.col(doc) != target).join(lengths.where("norm0 > 0"), F.col(group) == F.col("_ng"))
    return scored.select(group, doc, (F.col("dot") / (F.col("norm") * F.col("norm0"))).alias("similarity"))


def tfidf_cosine_of_words(docs: DataFrame, group: str, doc: str, target, words: str) -> DataFrame:
    """The same from one row a document with its array of words: documents are brought together once by group, and all counts
    after that are aggregates and windows inside the partition, so no word is shuffled alone."""
    some = docs.where(F.size(words) > 0).select(group, doc, words).repartition(group)
    some = some.withColumn("n_docs", F.count("*").over(Window.partitionBy(group)))
    counts = some.select(group, doc, "n_docs", F.explode(words).alias("_token")).groupBy(group, doc, "n_docs", "_token").agg(F.count("*").alias("tf"))
    goal, same = F.col(doc) == target, Window.partitionBy(group, "_token")
    known = counts.withColumns({"df": F.count("*").over(same), "tf0": F.coalesce(F.max(F.when(goal, F.col("tf"))).over(same), F.lit(0))})
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    weighted = known.select(group, doc, (F.col("tf") * idf).alias("w"), (F.col("tf0") * idf).alias("own"))
    sums = weighted.groupBy(group, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.col("own")).alias("dot"))
    sided = sums.withColumn("norm0", F.max(F.when(goal, F.col("norm"))).over(Window.partitionBy(group)))
    return sided.where((F.col(doc) != target) & (F.col("norm0") > 0)).select(group, doc, (F.col("dot") / (F.col("norm") * F.col("norm0"))).alias("similarity"))


def greedy_select(sizes: Column, budget: Column) -> Column:
    """Indexes taken by an ordered scan: an item that does not fit is skipped, later ones may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(acc, i):
        size = F.get(sizes, i).cast("long")
        fits = acc["used"] + size <= budget
        return F.struct(F.when(fits, acc["used"] + size).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(i))).otherwise(acc["taken"]).alias("taken"))

    n = F.size(sizes)
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["taken"])


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group with ``rank``; Spark limits each group before it is shuffled."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
