"""Build-log classification into test verdicts (built-in functions only).

A log is judged for one test: the class, the method and the path of its file. Names are matched literally.
The rules are tried in this order for a run that failed: compile errors in the test's own file, failures at
lines of the test method, the first summary line that gives a time, then known disturbances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID = ("success", "failure", "compile_error")
INVALID = (
    "timeout", "test_not_executed", "unrelated_compile_error", "expected_exception_failure", "test_match_failure", "unrelated_failure",
    "dependency_error", "pom_not_found", "invalid_edit_sequence", "unknown",
)
#: What a log says when something other than the test went wrong, in the order in which it is looked for.
COMPILES = ("COMPILATION ERROR", "Compilation failure:")
DISTURBANCES = (
    ("unrelated_compile_error", COMPILES),
    ("expected_exception_failure", ("java.lang.AssertionError: Expected exception:",)),
    ("test_match_failure", ("java.lang.Exception: No tests found matching Method",)),
    ("unrelated_failure", ("<<< ERROR!",)),
    ("dependency_error", ("Could not resolve dependencies", "Non-resolvable parent POM")),
)
#: Fixed value: the summary of a test class.
SUMMARY = r"Tests run: (\d+), Failures: (\d+), Errors: (\d+), Skipped: (\d+).*Time elapsed.*"
PASSED = r"Tests run: 0*1, Failures: 0+, Errors: 0+, Skipped: 0+\D.*Time elapsed"
TIMEOUT_CODE = 124


def is_valid(status: Column) -> Column:
    return status.isin(*VALID)


def is_broken(status: Column) -> Column:
    return status.isin("failure", "compile_error")


def _says(log: Column, phrases) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(log, F.lit(phrase))
    return found


def _lines(log: Column, pattern: Column) -> Column:
    """Sorted distinct numbers that group 1 of ``pattern`` finds, line by line."""
    found = F.regexp_extract_all(log, F.concat(F.lit("(?m)"), pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def _literal(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))


def classify_logs(df: DataFrame, log: str, code: str, test_class: str, test_method: str, path: str) -> DataFrame:
    """Adds ``status`` and ``error_lines`` (numbers in the test's file; null where a verdict has none).

    A null log is an empty one; a null code is a failed run."""
    text, own = F.coalesce(F.col(log), F.lit("")), _literal(F.col(test_class))
    method = _literal(F.col(test_method))
    compiled = _lines(text, F.concat(F.lit(r"^\[ERROR\]\s*/.+/"), _literal(F.col(path)), F.lit(r":\[(\d+),\d+\].*$")))
    reported = _lines(text, F.concat(F.lit(r"^\[ERROR\]\s*"), own, F.lit(r"\."), method, F.lit(r":(\d+).*$")))
    traced = _lines(text, F.concat(F.lit(r"^\s*at .+"), own, F.lit("."), method, F.lit(r"\("), own, F.lit(r"\.java:(\d+)\).*$")))
    failed = F.when(F.size(reported) > 0, reported).otherwise(traced)
    count = lambda n: F.regexp_extract(text, SUMMARY, n).cast("int")
    summed = text.rlike(SUMMARY)
    broken = F.col(code).isNull() | ~F.col(code).isin(0, TIMEOUT_CODE)
    own_compile = broken & _says(text, COMPILES) & (F.size(compiled) > 0)
    own_failure = broken & ~own_compile & (F.size(failed) > 0)
    counted = broken & ~own_compile & ~own_failure & summed & ((count(2) > 0) | (count(3) > 0))
    status = (
        F.when(F.col(code) == 0, F.when(text.rlike(PASSED), "success").otherwise("test_not_executed"))
        .when(F.col(code) == TIMEOUT_CODE, "timeout")
        .when(own_compile, "compile_error")
        .when(own_failure | counted, "failure")
        .when(summed & ((count(1) == 0) | (count(4) > 0)), "test_not_executed")
    )
    for name, phrases in DISTURBANCES:
        status = status.when(_says(text, phrases), name)
    none = F.array().cast("array<int>")
    return df.withColumns({"status": status.otherwise("unknown"), "error_lines": F.when(own_compile, compiled).when(own_failure, failed).when(counted, none)})


def error_sets(df: DataFrame, category: str, error: str) -> DataFrame:
    """``category, errors, n_rows``: the sorted distinct errors of each category, nulls left out of the set."""
    each = df.groupBy(F.col(category).alias("category"), F.col(error).alias("e")).agg(F.count("*").alias("n"))
    return each.groupBy("category").agg(F.array_sort(F.collect_list("e")).alias("errors"), F.sum("n").alias("n_rows"))


def evaluate_candidates(candidates: DataFrame, evaluate) -> DataFrame:
    """``ID, rank, candidate, status`` for each row of ``candidates`` (ID, rank, candidate, target).

    A candidate equal to its target succeeds without a run; of equal candidates of an id one is evaluated.
    ``evaluate`` maps distinct (ID, candidate) rows to the same with ``status``."""
    own = candidates.withColumn("candidate", F.btrim("candidate"))
    asked = own.where(~F.col("candidate").eqNullSafe(F.col("target"))).select("ID", "candidate").distinct()
    found = evaluate(asked).select(F.col("ID").alias("found_id"), F.col("candidate").alias("found_text"), F.col("status").alias("found"))
    joined = own.join(found, F.col("ID").eqNullSafe(F.col("found_id")) & F.col("candidate").eqNullSafe(F.col("found_text")), "left")
    return joined.select("ID", "rank", "candidate", F.when(F.col("candidate").eqNullSafe(F.col("target")), "success").otherwise(F.col("found")).alias("status"))


def ranked_predictions(predictions: DataFrame) -> DataFrame:
    """``ID, target, rank, candidate``: one row for each prediction, its place in the beam as rank."""
    return predictions.select("ID", "target", F.posexplode("preds").alias("rank", "candidate"))


def suppress_disturbed(df: DataFrame, key: str, status: str, least: float = 0.75) -> DataFrame:
    """Drops all rows of a key with more than one verdict when at least ``least`` are timeouts or dependency errors."""
    bad = F.when(F.col(status).isin("timeout", "dependency_error"), 1.0).otherwise(0.0)
    drop = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"), F.avg(bad).alias("b")).where((F.col("n") > 1) & (F.col("b") >= least))
    return df.join(drop.select("_k"), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
