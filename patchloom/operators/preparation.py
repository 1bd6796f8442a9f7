"""Steps between the records and the encoder: labelling hunks, why a commit has no changes, filters, label rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators.joins import match_join
from patchloom.operators.reports import share

#: Why a commit has no change documents.
NOT_FOUND, EMPTY, ALL_TESTS, PREPROCESSING, BOTH = "Not Found", "Originally Empty", "All Test Source", "Preproccessing", "Combination of Both"
LINES = "array<struct<line: string, type: string, lineNo: int>>"


def _side(hunk: Column, name: str) -> Column:
    return F.coalesce(hunk[name], F.array().cast(LINES))


def is_empty_hunk(hunk: Column) -> Column:
    return (F.size(_side(hunk, "sourceChanges")) == 0) & (F.size(_side(hunk, "targetChanges")) == 0)


def words_of(lines: Column) -> Column:
    """The blank-separated words of an array of line changes."""
    return F.filter(F.split(F.array_join(F.transform(lines, lambda x: x["line"]), " "), r"\s+"), lambda w: w != "")


def is_blank_hunk(hunk: Column) -> Column:
    """Whether both sides of a formatted hunk have the same words, so that only white space changes."""
    return words_of(_side(hunk, "sourceChanges")) == words_of(_side(hunk, "targetChanges"))


def label_hunks(class_changes: DataFrame, method_changes: DataFrame) -> DataFrame:
    """``class_changes`` (project, aCommit, path, hunk_no, hunk) with ``scope`` and ``methodName``.

    A hunk at the place (first source and target line) of a method's hunk in the same file is that method's;
    of several methods at one place the last in order (``ord``) names it. Every other hunk is the class's."""
    place = lambda h: T.hunk_location(h["sourceChanges"], h["targetChanges"])
    key = F.concat_ws("|", "project", "aCommit", "path", place(F.col("hunk")))
    known = method_changes.select(key.alias("_place"), F.col("name").alias("methodName"), "ord")
    joined = match_join(class_changes.withColumn("_place", key), known, "_place", F.col("ord"), ["methodName"], last=True)
    return joined.drop("_place").withColumn("scope", F.when(F.col("methodName").isNull(), "class").otherwise("method"))


def preprocess_changes(changes: DataFrame) -> DataFrame:
    """Per commit (project, aCommit, changes): ``n_changes, n_sources, left, n_hunks, no_words, no_lines``.

    ``left`` are the changes that are no test source and keep a hunk once hunks that change only white space
    (``no_words`` counts them) or nothing (``no_lines``) are gone; ``n_hunks`` counts what is left."""
    sources = F.filter("changes", lambda c: ~F.coalesce(c["is_test_source"], F.lit(False)))
    sized = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, c: n + F.size(F.coalesce(c["hunks"], F.array())))
    keep = lambda x, bad: F.filter(F.transform(x, lambda c: c.withField("hunks", F.filter(c["hunks"], lambda h: ~bad(h)))), lambda c: F.size(c["hunks"]) > 0)
    own = changes.withColumn("_sources", sources)
    own = own.withColumn("_worded", keep(F.col("_sources"), is_blank_hunk)).withColumn("left", keep(F.col("_worded"), is_empty_hunk))
    return own.select(
        "project", "aCommit", F.size("changes").alias("n_changes"), F.size("_sources").alias("n_sources"), "left",
        sized(F.col("left")).alias("n_hunks"), (sized(F.col("_sources")) - sized(F.col("_worded"))).alias("no_words"), (sized(F.col("_worded")) - sized(F.col("left"))).alias("no_lines"),
    )


def empty_reason(n_changes: Column, n_sources: Column, n_left: Column) -> Column:
    """Why a commit has no change left; null if it has one. A commit without a record has null counts."""
    return (
        F.when(n_changes.isNull(), NOT_FOUND).when(n_changes == 0, EMPTY).when(n_sources == 0, ALL_TESTS)
        .when((n_left == 0) & (n_sources == n_changes), PREPROCESSING).when(n_left == 0, BOTH)
    )


def with_changes(repairs: DataFrame, processed: DataFrame) -> DataFrame:
    """``repairs`` with ``commitChanges`` (empty if there are none) and ``reason`` (null if there are some)."""
    own = processed.select(F.col("project").alias("_p"), F.col("aCommit").alias("_c"), "n_changes", "n_sources", F.col("left").alias("_left"))
    joined = repairs.join(own, F.col("project").eqNullSafe(F.col("_p")) & F.col("aCommit").eqNullSafe(F.col("_c")), "left")
    kind = processed.schema["left"].dataType
    filled = joined.withColumns({"commitChanges": F.coalesce("_left", F.array().cast(kind)), "reason": empty_reason(F.col("n_changes"), F.col("n_sources"), F.size("_left"))})
    return filled.drop("_p", "_c", "_left", "n_changes", "n_sources")


def reason_counts(repairs: DataFrame) -> DataFrame:
    """``reason, n`` over the repairs of commits without changes."""
    return repairs.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def hunk_counters(processed: DataFrame) -> DataFrame:
    """``step_no, step, removed, pct, remaining``: hunks that each step removed, in percent of those it met."""
    total = processed.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_hunks", "no_words", "no_lines")])
    first = F.col("n_hunks") + F.col("no_words") + F.col("no_lines")
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), n.alias("removed"), met.alias("met")) for i, (s, n, met) in enumerate((("white space", F.col("no_words"), first), ("empty", F.col("no_lines"), first - F.col("no_words"))))])
    each = total.select(F.inline(rows))
    return each.select("step_no", "step", "removed", F.when(F.col("met") == 0, 0.0).otherwise(share(F.col("removed"), F.greatest("met", F.lit(1)))).alias("pct"), (F.col("met") - F.col("removed")).alias("remaining"))


def with_changes_only(repairs: DataFrame) -> DataFrame:
    return repairs.where(F.size(F.coalesce("commitChanges", F.array())) > 0)


def without_ids(repairs: DataFrame, ids: DataFrame | None) -> DataFrame:
    """``repairs`` without the listed ``ID`` values (too long ones, say); all of them if there is no list."""
    return repairs if ids is None else repairs.join(ids.select(F.col("ID").alias("_gone")).distinct(), F.col("ID") == F.col("_gone"), "left_anti")


def run_steps(rows: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The rows after all steps, and how many rows each left; one counting pass for each step."""
    counts = [("read", rows.count())]
    for name, step in steps:
        rows = step(rows)
        counts.append((name, rows.count()))
    return rows, counts


def fits(inputs: Column, outputs: Column, most: int, joined: bool = False) -> Column:
    """Whether token arrays fit a model: each side alone, or (``joined``: a decoder reads the input with the output) together."""
    return F.size(inputs) + F.size(outputs) <= most if joined else (F.size(inputs) <= most) & (F.size(outputs) <= most)


def max_input(most: int, joined: bool = False) -> int:
    """Tokens that documents may fill: a decoder reads two thirds of its window as input."""
    return most * 2 // 3 if joined else most


def decoder_row(inputs: Column, outputs: Column, ignored: int = -100) -> Column:
    """struct(input_ids, labels, attention_mask) of a decoder: the output is read after the input and alone is learnt."""
    ids = F.concat(inputs, outputs)
    labels = F.concat(F.array_repeat(F.lit(ignored), F.size(inputs)), outputs)
    return F.struct(ids.alias("input_ids"), labels.alias("labels"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"))


def pad_row(row: Column, width: Column, label_width: Column, fill: int = 0, ignored: int = -100) -> Column:
    """``row`` with its three arrays filled up to the widths of its batch."""
    return F.struct(
        T.pad(row["input_ids"], width, fill).alias("input_ids"), T.pad(row["labels"], label_width, ignored).alias("labels"), T.pad(row["attention_mask"], width, 0).alias("attention_mask"),
    )


def tagged(inputs: Column, outputs: Column, end: str, language: str) -> Column:
    """struct(input, output) with the language after the input's end and before the output."""
    return F.struct(F.concat(inputs, F.lit(end + language)).alias("input"), F.concat(F.lit(language), outputs, F.lit(end)).alias("output"))


def inclusion_ratio(selected: DataFrame, taken: str, available: str) -> DataFrame:
    """One row ``n_selected, n_available, pct``: a row that took none counts one, its first document that stands in."""
    total = selected.agg(F.sum(F.greatest(F.size(taken), F.lit(1))).alias("n_selected"), F.sum(F.size(available)).alias("n_available"))
    return total.withColumn("pct", share(F.col("n_selected"), F.col("n_available")))


def apply_patch(contents: Column, hunk: Column, before: Column, after_code: Column, patch: Column) -> Column:
    """``contents`` with a candidate in place of a hunk's added lines.

    Without added lines the later method text is exchanged for the earlier one (struct startLine, code) whose
    deleted lines the candidate replaces. Line numbers count from 1."""
    number = lambda xs: F.transform(xs, lambda x: x["lineNo"])
    added, deleted = number(_side(hunk, "targetChanges")), number(_side(hunk, "sourceChanges"))
    at = F.get(added, F.lit(0)) - 1
    direct = F.array_join(T.splice_lines(F.split(contents, "\n"), F.transform(added, lambda n: n - 1), at, F.array(patch)), "\n")
    start = before["startLine"]
    rebuilt = T.splice_lines(F.split(before["code"], "\n"), F.transform(deleted, lambda n: n - start), F.get(deleted, F.lit(0)) - start, F.array(patch))
    return F.when(F.size(added) > 0, direct).otherwise(F.replace(contents, after_code, F.array_join(rebuilt, "\n")))
