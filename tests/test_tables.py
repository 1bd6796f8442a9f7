"""Table functions in SQL, and project files without plugins."""

import re

from patchloom.functions import java, tables


def test_rows_of_pairs(spark):
    tables.register(spark)
    pairs = spark.createDataFrame([(1, "a\nb\n\nc", "a\nx\ny\n\nc"), (2, "same", "same"), (3, None, "new"), (4, None, None), (5, "gone\n ", "")], "id int, b string, a string")
    found = {}
    for r in spark.sql("SELECT p.id, h.* FROM {p} p, LATERAL hunk_lines(p.b, p.a) h", p=pairs).collect():
        found.setdefault(r.id, []).append((r.hunk_no, r.hunk_type, r.line_type, r.line_no, r.line))
    assert found == {
        1: [(0, "MODIFY", "DELETE", 1, "b"), (0, "MODIFY", "ADD", 1, "x"), (0, "MODIFY", "ADD", 2, "y")],
        3: [(0, "ADD", "ADD", 0, "new")],
        5: [(0, "DELETE", "DELETE", 0, "gone")],
    }
    words = spark.sql("SELECT e.* FROM {p} p, LATERAL word_edits(p.b, p.a) e WHERE p.id = 3", p=pairs).collect()
    assert [tuple(r) for r in words] == [(0, 1, "new")]


def test_blocks_of_sequences(spark):
    tables.register(spark)
    two = "[<replaceOld>] n [<replaceNew>] z [<replaceEnd>] [<replaceOldKeepBefore>] q p [<replaceNewKeepBefore>] q y [<replaceEnd>]"
    rows = spark.createDataFrame([(1, two), (2, None), (3, "no sequence"), (4, "")], "id int, s string")
    found = spark.sql("SELECT r.id, e.* FROM {r} r, LATERAL edit_blocks(r.s) e ORDER BY 1, 2", r=rows).collect()
    assert [tuple(r) for r in found] == [(1, 0, "plain", "n", "z"), (1, 1, "before", "q p", "q y")]


def test_first_plugin_and_its_copies_go(spark):
    one = lambda group, name, more="": f"<plugin>\n <groupId>{group}</groupId>\n<artifactId>{name}</artifactId>{more}</plugin>"
    bugs, ids = java.UNNEEDED[0], java.UNNEEDED[2]
    texts = [one(*bugs) + one("g", "a") + one(*bugs) + one(*bugs, "<version>2</version>"), one("orgXcodehaus.mojo", bugs[1]), one(*ids, "\n$1\\"), "", None, "<plugin><artifactId>x</artifactId>" + one(*bugs)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, pom string")

    def plain(text):
        for group, name in java.UNNEEDED:
            hit = re.search(rf"<plugin>\s*<groupId>{re.escape(group)}</groupId>\s*<artifactId>{re.escape(name)}</artifactId>.*?</plugin>", text or "", re.DOTALL)
            text = text.replace(hit.group(), "") if hit else text
        return text

    found = {r.i: r.p for r in rows.select("i", java.without_plugins(rows.pom).alias("p")).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}
    assert found[0] == one("g", "a") + one(*bugs, "<version>2</version>") and found[2] == ""
