"""Differences between two versions of a code base, from tables of what each version declares.

Executables are rows ``commit, file, parent, signature, kind, line, n_lines, body, code`` of one version: the
qualified name of the declaring type, the simple signature, ``method`` or ``constructor``, the first line, the
number of lines of the file, and the printed body and whole text (null if there is none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import code as C
from patchloom.functions.similarity import SIMILARITY_THRESHOLD, jaro_winkler, line_distance, overall
from patchloom.operators.reports import share, value_counts

KEYS = ["commit", "file"]


def local_name(parent: Column, signature: Column) -> Column:
    """The signature, after the names of the inner types that hold it (``a.B$C`` gives ``C.``)."""
    inner = F.array_join(F.slice(F.split(parent, r"\$"), F.lit(2), F.greatest(F.size(F.split(parent, r"\$")) - 1, F.lit(0))), ".")
    return F.when(F.contains(parent, F.lit("$")), F.concat(inner, F.lit("."), signature)).otherwise(signature)


def is_modified(before: Column, after: Column) -> Column:
    """Whether two printed texts differ; a missing text counts as a difference."""
    return before.isNull() | after.isNull() | (before != after)


def _named(version: DataFrame) -> DataFrame:
    return version.withColumn("local", local_name(F.col("parent"), F.col("signature")))


def _first(version: DataFrame) -> DataFrame:
    """One row for each local name of a file: the earliest in the file."""
    payload = [c for c in version.columns if c not in (*KEYS, "local")]
    one = version.groupBy(*KEYS, "local").agg(F.min_by(F.struct(*payload), F.struct("line", "signature", "parent")).alias("r"))
    return one.select(*KEYS, "local", "r.*")


def common_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``commit, file, name, before_code, after_code`` of executables that both versions have, with another text."""
    own = _first(_named(before)).select(*KEYS, "local", F.concat_ws("#", "parent", "signature").alias("name"), F.col("code").alias("before_code"))
    joined = own.join(_named(after).select(*KEYS, "local", F.col("code").alias("after_code")), [*KEYS, "local"])
    return joined.where(is_modified(F.col("before_code"), F.col("after_code"))).select(*KEYS, "name", "before_code", "after_code")


def unmatched(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Executables whose local name only the first (missing) or only the second version (new) of the file has."""
    a, b = _named(before), _named(after)
    return a.join(b, [*KEYS, "local"], "left_anti"), b.join(a, [*KEYS, "local"], "left_anti")


def similarity_bound(before: Column, after: Column) -> Column:
    """At most so similar are two executables by their signatures' and bodies' lengths alone (the line term is taken as 1).

    The Jaro part is at most (2 + shorter / longer) / 3 and the prefix bonus closes at most 4/10 of what is left."""
    def most(a: Column, b: Column) -> Column:
        low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
        jaro = F.when(high == 0, 1.0).when(low == 0, 0.0).otherwise((2 + low / F.greatest(high, F.lit(1))) / 3)
        return jaro + 0.4 * (1 - jaro)

    text = lambda x: F.coalesce(x["body"], F.lit(""))
    return (1.25 * most(before["signature"], after["signature"]) + most(text(before), text(after)) + 0.75) / 3.0


def renamed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``commit, file, name, matched, similarity, before_code, after_code``: what became of every missing executable.

    It is matched with the most similar new one of its file and kind (the earliest in a tie) if the similarity
    exceeds the threshold; a match with the same text is no change; without a match the code is deleted
    (``matched`` and ``after_code`` null). Pairs whose lengths exclude the threshold are not compared."""
    missing, new = unmatched(before, after)
    row = F.struct("parent", "signature", "kind", "line", "n_lines", "body", "code")
    pairs = missing.select(*KEYS, "kind", "local", row.alias("b")).join(new.select(*KEYS, "kind", row.alias("a")), [*KEYS, "kind"])
    pairs = pairs.where(similarity_bound(F.col("b"), F.col("a")) > SIMILARITY_THRESHOLD)
    blank = lambda x: F.coalesce(x, F.lit(""))
    body = F.when(F.col("b.body").isNull() & F.col("a.body").isNull(), 1.0).otherwise(jaro_winkler(blank(F.col("b.body")), blank(F.col("a.body"))))
    near = line_distance(F.col("b.line"), F.col("a.line"), F.greatest("b.n_lines", "a.n_lines"))
    scored = pairs.withColumn("similarity", overall(jaro_winkler(F.col("b.signature"), F.col("a.signature")), body, near)).where(F.col("similarity") > SIMILARITY_THRESHOLD)
    best = scored.groupBy(*KEYS, "local", "b").agg(F.min_by(F.struct("a", "similarity"), F.struct(-F.col("similarity"), F.col("a.line"), F.col("a.signature"))).alias("m"))
    found = best.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("b").alias("_b"), "m")
    same = F.col("b").eqNullSafe(F.col("_b"))
    for k in KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = missing.select(*KEYS, row.alias("b")).join(found, same, "left")
    name = lambda x: F.concat_ws("#", x["parent"], x["signature"])
    out = own.select(*KEYS, name(F.col("b")).alias("name"), F.when(F.col("m").isNotNull(), name(F.col("m.a"))).alias("matched"), F.col("m.similarity").alias("similarity"), F.col("b.code").alias("before_code"), F.col("m.a.code").alias("after_code"))
    return out.where(F.col("matched").isNull() | is_modified(F.col("before_code"), F.col("after_code")))


def executable_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``commit, file, name, hunks`` of every changed or vanished executable; a deleted one is all deleted lines."""
    both = common_changes(before, after).unionByName(renamed(before, after).select(*KEYS, "name", "before_code", "after_code"))
    return both.select(*KEYS, "name", C.hunks_of("before_code", "after_code").alias("hunks"))


def deleted_when_nothing_new(before: DataFrame, after: DataFrame) -> DataFrame:
    """``commit, file, name, before_code`` of missing executables of files that gained none."""
    missing, new = unmatched(before, after)
    return missing.join(new.select(*KEYS).distinct(), KEYS, "left_anti").select(*KEYS, F.concat_ws("#", "parent", "signature").alias("name"), F.col("code").alias("before_code"))


def class_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``commit, file, name, before_code, after_code`` of top-level types (commit, file, name, code) that both versions have and that differ."""
    b = after.select(*KEYS, F.col("code").alias("after_code"))
    return before.select(*KEYS, "name", F.col("code").alias("before_code")).join(b, KEYS).where(is_modified(F.col("before_code"), F.col("after_code")))


#: How a test class shows itself.
TEST_IMPORT, TEST_MARK = r"import org\.junit\.(Test|\*|jupiter\.api\.(\*|Test));", r"@Test"


def is_test(code: Column) -> Column:
    """Whether a source file imports the test annotation and uses it."""
    return F.coalesce(code.rlike(TEST_IMPORT) & code.rlike(TEST_MARK), F.lit(False))


def changed_test_classes(files: DataFrame) -> DataFrame:
    """The rows of ``files`` (before, after texts) whose earlier text is a test class and differs from the later."""
    return files.where(is_test(F.col("before")) & ~F.col("before").eqNullSafe(F.col("after")))


def flag_test_sources(changes: DataFrame, known: DataFrame, mark: str = "src/test") -> DataFrame:
    """``changes`` (bPath, aPath) with ``is_test_source``: either path is one of ``known`` (path) or contains ``mark``."""
    paths = known.select("path").distinct()
    joined = changes
    flag = F.lit(False)
    for i, side in enumerate(("bPath", "aPath")):
        joined = joined.join(paths.withColumnRenamed("path", f"_known{i}"), F.col(side) == F.col(f"_known{i}"), "left")
        flag = flag | F.col(f"_known{i}").isNotNull() | F.coalesce(F.contains(F.col(side), F.lit(mark)), F.lit(False))
    return joined.withColumn("is_test_source", flag).drop("_known0", "_known1")


def changed_tests(before: DataFrame, after: DataFrame) -> DataFrame:
    """``commit, name, before_code, after_code`` of tests in both versions whose text differs.

    A name that the earlier version has twice is an error, as it cannot be told which one changed."""
    twice = before.groupBy("commit", "name").agg(F.count("*").alias("n"), F.first("code").alias("before_code"))
    single = twice.select("commit", "name", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("test declared twice: "), "name")).cast("string")).otherwise(F.col("before_code")).alias("before_code"))
    joined = single.join(after.select("commit", "name", F.col("code").alias("after_code")), ["commit", "name"])
    return joined.where(is_modified(F.col("before_code"), F.col("after_code")))


def with_source(rows: DataFrame, sources: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` of ``sources``; a key that ``sources`` lacks is an error when its row is read."""
    found = sources.select(F.col(key).alias("_key"), F.struct(column).alias("_found"))
    joined = rows.join(found, F.col(key) == F.col("_key"), "left")
    value = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit(f"no {column} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string")).otherwise(F.col(f"_found.{column}").cast("string"))
    return joined.withColumn(column, value).drop("_key", "_found")


def with_list(rows: DataFrame, lists: DataFrame, key: str, item: str, name: str) -> DataFrame:
    """``rows`` with the sorted ``item`` values of their key as an array; an empty one where there are none."""
    found = lists.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(item)).alias(name))
    kind = found.schema[name].dataType
    return rows.join(found, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce(name, F.array().cast(kind))).drop("_key")


def by_either_commit(repairs: DataFrame) -> DataFrame:
    """``commit, ids``: the sorted ids of the repairs that a commit is the earlier or the later version of."""
    pairs = repairs.select(F.col("bCommit").alias("commit"), "ID").unionByName(repairs.select(F.col("aCommit").alias("commit"), "ID")).distinct()
    return pairs.groupBy("commit").agg(F.array_sort(F.collect_list("ID")).alias("ids"))


def only_tests_changed(actions: DataFrame, key: str, inside: str) -> DataFrame:
    """``key, only_tests``: whether a file has root actions and all of them lie inside a test method."""
    return actions.groupBy(key).agg((F.coalesce(F.bool_and(F.coalesce(F.col(inside), F.lit(False))), F.lit(False)) & (F.count("*") > 0)).alias("only_tests"))


def real_actions(actions: DataFrame, key: str) -> DataFrame:
    """Actions without those that name no node, unless the action is its key's only one."""
    several = actions.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    joined = actions.join(several, F.col(key) == F.col("_key"))
    return joined.where(~(F.col("srcNode").isNull() & F.col("dstNode").isNull() & (F.col("_n") > 1))).drop("_key", "_n")


def single_hunk(changes: DataFrame) -> DataFrame:
    return changes.where(F.size("hunks") == 1)


def repair_hunk(repairs: DataFrame, test_changes: DataFrame) -> DataFrame:
    """``repairs`` with ``hunk`` taken from the first single-hunk change of the test (aCommit, name, hunks, ord), else their own."""
    one = single_hunk(test_changes).groupBy(F.col("aCommit").alias("_c"), F.col("name").alias("_n")).agg(F.min_by(F.get("hunks", F.lit(0)), "ord").alias("_h"))
    joined = repairs.join(one, (F.col("aCommit") == F.col("_c")) & (F.col("name") == F.col("_n")), "left")
    return joined.withColumn("hunk", F.coalesce("_h", "hunk")).drop("_c", "_n", "_h")


#: Refactorings that rename classes and methods, by title and by constant.
RENAMES = ("Rename Class", "Rename Method", "Move And Rename Class", "RENAME_CLASS", "RENAME_METHOD", "MOVE_RENAME_CLASS")


def renames_only(refactorings: DataFrame, kind: str = "type", kinds: tuple[str, ...] = RENAMES) -> DataFrame:
    return refactorings.where(F.col(kind).isin(*kinds))


def refactorings_by_signature(refactorings: DataFrame) -> DataFrame:
    """``signature, types``: every type of refactoring of a method, repeats included, sorted."""
    return refactorings.groupBy("signature").agg(F.array_sort(F.collect_list("type")).alias("types"))


def elements_on_lines(elements: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """``elements`` (key, line, value) with a value that stand on one of the key's ``lines`` (key, line)."""
    return elements.where("value IS NOT NULL").join(lines.select(key, "line").distinct(), [key, "line"], "left_semi")


def resolvable_calls(calls: DataFrame) -> DataFrame:
    """Calls whose callee is declared in the code, has a body and is a method or constructor."""
    return calls.where(F.col("declared") & F.col("has_body") & F.col("kind").isin("method", "constructor"))


def covered_lines(events: DataFrame, classes: DataFrame) -> DataFrame:
    """``test, module, class, line``: line events of classes of the project; an inner class may stand under its outer one."""
    own = events.where("event = 'LINE_NUMBER'").select("test", "class", "line").distinct()
    known = classes.select(F.col("class").alias("known"), "module").distinct()
    exact = own.join(known, F.col("class") == F.col("known"), "left").withColumnsRenamed({"known": "k1", "module": "m1"})
    outer = known.withColumnsRenamed({"known": "k2", "module": "m2"})
    both = exact.join(outer, F.substring_index("class", "$", 1) == F.col("k2"), "left")
    return both.select("test", F.coalesce("m1", "m2").alias("module"), "class", "line").where("module IS NOT NULL")


def lines_by_test(covered: DataFrame) -> DataFrame:
    """``commit, tests``: a map of test to its sorted distinct lines."""
    each = covered.groupBy("commit", "test").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return each.groupBy("commit").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("test", "lines")))).alias("tests"))


def execution_summary(runs: DataFrame) -> DataFrame:
    """``measure, value, n, pct``: share of changed tests that were repaired, and histograms of verdicts and outcomes.

    ``runs`` has a row for each changed test: repaired (boolean), verdict, outcome, original verdict."""
    total = runs.agg(F.coalesce(F.sum(F.col("repaired").cast("int")), F.lit(0)).alias("n"), F.count("*").alias("all"))
    repaired = total.select(F.lit("repaired").alias("measure"), F.lit(None).cast("string").alias("value"), F.col("n").cast("long").alias("n"), F.when(F.col("all") == 0, -1.0).otherwise(share(F.col("n"), F.greatest("all", F.lit(1)))).alias("pct"))
    failing = runs.where("original <> 'success'")
    parts = [("verdict", runs, "verdict"), ("outcome", runs, "outcome"), ("originally failing", failing, "original")]
    out = repaired
    for name, rows, column in parts:
        out = out.unionByName(value_counts(rows, column).select(F.lit(name).alias("measure"), "value", "n", "pct"))
    return out


def reachable(graph: DataFrame, max_depth: int = 1 << 20) -> DataFrame:
    """``root, node, depth, id``: every node that calls reach from a root (commit, test) with its dense number.

    Numbers follow depth, then name. ``graph`` has ``root, src, dst`` edges; the root is a node itself."""
    from patchloom.operators.graph import bfs_depth

    edges = graph.select(F.concat_ws("\x1f", "root", "src").alias("src"), F.concat_ws("\x1f", "root", "dst").alias("dst")).distinct()
    roots = graph.select(F.concat_ws("\x1f", "root", "root").alias("root")).distinct()
    found = bfs_depth(edges, roots, max_depth).select(F.split("root", "\x1f")[0].alias("root"), F.split("node", "\x1f")[1].alias("node"), "depth")
    order = Window.partitionBy("root").orderBy("depth", "node")
    return found.withColumn("id", F.row_number().over(order) - 1)
