"""Goldens of version, preparation and text operators that the catalogue does not reach."""

import pytest
from pyspark.sql import functions as F

from patchloom.functions import edits, java
from patchloom.functions import text as T
from patchloom.operators import history, preparation

EXECUTABLE = "commit string, file string, parent string, signature string, kind string, line int, n_lines int, body string, code string"


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_executable_changes(spark):
    before = [
        ("c", "A.java", "p.A", "same()", "method", 1, 50, "{ a }", "same {\n a\n}"), ("c", "A.java", "p.A", "edited()", "method", 5, 50, "{ b }", "edited {\n b\n}"),
        ("c", "A.java", "p.A$In", "edited()", "method", 9, 50, "{ b }", "inner {\n b\n}"), ("c", "A.java", "p.A", "renamedOne(int)", "method", 20, 50, "{ return one; }", "int renamedOne {\n return one;\n}"),
        ("c", "B.java", "p.B", "gone()", "method", 3, 9, "{ x }", "gone {\n x\n}"),
    ]
    after = [
        ("c", "A.java", "p.A", "same()", "method", 1, 50, "{ a }", "same {\n a\n}"), ("c", "A.java", "p.A", "edited()", "method", 5, 50, "{ c }", "edited {\n c\n}"),
        ("c", "A.java", "p.A$In", "edited()", "method", 9, 50, "{ b }", "inner {\n b\n}"), ("c", "A.java", "p.A", "renamedTwo(int)", "method", 20, 50, "{ return one; }", "int renamedTwo {\n return one;\n}"),
    ]
    a, b = spark.createDataFrame(before, EXECUTABLE), spark.createDataFrame(after, EXECUTABLE)
    assert rows(history.common_changes(a, b), "name") == [("p.A#edited()",)]
    found = {r.name: (r.matched, r.after_code is None) for r in history.renamed(a, b).collect()}
    assert found == {"p.A#renamedOne(int)": ("p.A#renamedTwo(int)", False), "p.B#gone()": (None, True)}
    hunks = {r.name: r.hunks for r in history.executable_changes(a, b).collect()}
    assert set(hunks) == {"p.A#edited()", "p.A#renamedOne(int)", "p.B#gone()"}
    assert [h.type for h in hunks["p.B#gone()"]] == ["DELETE"] and len(hunks["p.B#gone()"][0].sourceChanges) == 3
    assert rows(history.deleted_when_nothing_new(a, b), "name") == [("p.B#gone()",)]


def test_length_bound_never_hides_a_match(spark):
    import random

    from patchloom.functions.similarity import jaro_winkler_score

    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(400)]
    data = [(words[i], words[i + 1], words[i + 2], words[i + 3]) for i in range(0, 396, 4)]
    side = lambda s, b: F.struct(F.col(s).alias("signature"), F.col(b).alias("body"))
    frame = spark.createDataFrame(data, "s string, t string, u string, v string")
    bounds = [x.b for x in frame.select(history.similarity_bound(side("s", "u"), side("t", "v")).alias("b")).collect()]
    for (s, t, u, v), bound in zip(data, bounds):
        assert (1.25 * jaro_winkler_score(s, t) + jaro_winkler_score(u, v) + 0.75) / 3 <= bound + 1e-9


def test_changed_tests_need_unique_names(spark):
    before = spark.createDataFrame([("c", "t", "a"), ("c", "t", "b")], "commit string, name string, code string")
    with pytest.raises(Exception, match="declared twice"):
        history.changed_tests(before, before).collect()
    with pytest.raises(Exception, match="no source for"):
        history.with_source(spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([("y", "s")], "name string, source string"), "name", "source").collect()


def test_small_tables(spark):
    covered = spark.createDataFrame([("c", "t", 3), ("c", "t", 1), ("c", "t", 3), ("c", "u", 2)], "commit string, test string, line int")
    assert history.lines_by_test(covered).first().tests == {"t": [1, 3], "u": [2]}
    kinds = spark.createDataFrame([("m()", "Rename Method"), ("m()", "Add Parameter"), ("n()", "Rename Method")], "signature string, type string")
    assert rows(history.refactorings_by_signature(kinds), "signature", F.array_join("types", ",")) == [("m()", "Add Parameter,Rename Method"), ("n()", "Rename Method")]
    assert history.renames_only(kinds).count() == 2
    repairs = spark.createDataFrame([("1", ["x"]), ("2", []), ("3", None)], "ID string, commitChanges array<string>")
    left, counts = preparation.run_steps(repairs, [("changes", preparation.with_changes_only), ("ids", lambda t: preparation.without_ids(t, spark.createDataFrame([("1",)], "ID string")))])
    assert left.count() == 0 and counts == [("read", 3), ("changes", 1), ("ids", 0)]
    both = spark.range(1).select(preparation.tagged(F.lit("in"), F.lit("out"), "</s>", "__java__").alias("x")).first().x
    assert (both.input, both.output) == ("in</s>__java__", "__java__out</s>")
    assert preparation.max_input(512, True) == 341 and preparation.max_input(512) == 512


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for url in ("https://host/owner/name.git", "git@host:owner/name.git", "https://host/owner/name/"):
        assert one(T.repository_path(F.lit(url))) == "owner/name"
    assert one(T.printed_alike(F.lit("a  b\n"), F.lit("ab"))) and not one(T.printed_alike(F.lit("a"), F.lit(None).cast("string")))
    assert [one(T.count_lines(F.lit(x))) for x in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]


def test_edit_sequences(spark):
    assert edits.is_default("a", "b", edits.edit_sequence("a", "b")) in (True, False)
    assert edits.strip_special("<s> [<replaceOld>] a <pad> [<replaceNew>] b [<replaceEnd>]</s>", ("<s>", "</s>", "<pad>")) == "[<replaceOld>] a [<replaceNew>] b [<replaceEnd>]"
    assert edits.parse("[<replaceOld>] a [<replaceEnd>]") is None and edits.apply("a a", "[<replaceOld>] a [<replaceNew>] b [<replaceEnd>]") is None
    assert edits.decode("x", "no sequence") == edits.INVALID and edits.decode(None, "x") is None


def test_java_homes(spark):
    homes = java.java_homes(F.lit('{"8": "a", "11": "b", "17": "c"}'))
    got = [spark.range(1).select(java.chosen_home(F.lit(v).cast("int"), homes).alias("x")).first().x for v in (8, 9, 12, 21, None)]
    assert got == ["a", "b", "c", "b", "b"]


def test_versions_of_project_files_need_few_parses(spark):
    """Main plugins first, then others, then properties; a document is not parsed once for each place."""
    plugin = lambda name, body: f"<plugin><artifactId>{name}</artifactId>{body}</plugin>"
    other = plugin("maven-compiler-plugin", "<executions><execution><configuration><release>14</release></configuration></execution><execution><configuration><release>15</release></configuration></execution></executions>")
    rows = [
        ("", []), ("<properties><java.version> 11 </java.version><maven.compiler.source>8</maven.compiler.source></properties>", ["11", "8"]),
        (f"<properties><x>7</x></properties><build><plugins>{plugin('maven-compiler-plugin', '<configuration><release>${x}</release><source>9</source></configuration>')}</plugins></build>", ["7"]),
        (f"<properties><jdk.version>6</jdk.version></properties><build><plugins>{plugin('maven-<!-- -->compiler-plugin', '<configuration><source>9</source></configuration>')}</plugins></build>", ["9"]),
        (f"<profiles><profile><build><plugins>{other}</plugins></build></profile></profiles>", ["14", "15"]),
    ]
    poms = spark.createDataFrame([(f"<project>{body}</project>", want) for body, want in rows], "pom string, want array<string>")
    found = java.detected_versions(F.col("pom"))
    assert all(r.got == r.want for r in poms.select("want", found.alias("got")).collect())
    plan = poms.select(java.greatest_version(F.col("pom")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xpath") <= 12
