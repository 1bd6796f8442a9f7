"""Queries over two versions of a code base and over the changes of commits, on records made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom import schemas
from patchloom.operators import encoders, history, preparation, renames
from patchloom.plans.registry import query, table

SIDE = "SELECT p_brand AS commit, p_type AS file, 'q.' || p_type || CASE WHEN p_partkey % 4 = 0 THEN '$In' ELSE '' END AS parent, {0} AS signature, CASE WHEN p_partkey % 5 = 0 THEN 'constructor' ELSE 'method' END AS kind, CAST(p_partkey AS INTEGER) AS line, 100000 AS n_lines, {1} AS body, {1} AS code, p_partkey FROM part WHERE {2}"
BEFORE = SIDE.format("p_name || '()'", "'{ old ' || p_size || ' }'", "p_partkey % 7 <> 6")
AFTER = SIDE.format("CASE WHEN p_partkey % 3 = 1 THEN p_name || '2()' ELSE p_name || '()' END", "CASE WHEN p_partkey % 2 = 0 THEN '{ old ' || p_size || ' }' ELSE '{ new ' || p_size || ' }' END", "p_partkey % 3 <> 2")


def _versions(spark, d):
    table(spark, d, "part").createOrReplaceTempView("patchloom_part")
    return tuple(spark.sql(side.replace("FROM part", "FROM patchloom_part")).drop("p_partkey") for side in (BEFORE, AFTER))


LOCAL = "CASE WHEN contains(parent, '$') THEN split_part(parent, '$', 2) || '.' || signature ELSE signature END AS local"
BOTH = f"b AS (SELECT *, {LOCAL} FROM ({BEFORE})), a AS (SELECT *, {LOCAL} FROM ({AFTER})), bf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit, file, local ORDER BY line) AS r FROM b) WHERE r = 1)"


@query(f"WITH {BOTH} SELECT commit, file, bf.parent || '#' || bf.signature AS name, bf.code AS before_code, a.code AS after_code FROM bf JOIN a USING (commit, file, local) WHERE bf.code <> a.code")
def common_executables(spark, d):
    """Executables of both versions by local name (the first wins) whose text differs."""
    return history.common_changes(*_versions(spark, d))


@query(f"WITH {BOTH} SELECT 'missing' AS side, commit, file, local FROM b ANTI JOIN a USING (commit, file, local) UNION ALL SELECT 'new', commit, file, local FROM a ANTI JOIN b USING (commit, file, local)")
def unmatched_executables(spark, d):
    missing, new = history.unmatched(*_versions(spark, d))
    return missing.select(F.lit("missing").alias("side"), "commit", "file", "local").unionByName(new.select(F.lit("new").alias("side"), "commit", "file", "local"))


RENAMED = f"""{BOTH}, m AS (SELECT b.* FROM b ANTI JOIN a USING (commit, file, local)), w AS (SELECT a.* FROM a ANTI JOIN b USING (commit, file, local)),
s AS (SELECT m.commit, m.file, m.parent || '#' || m.signature AS name, w.parent || '#' || w.signature AS matched, m.line AS ml, m.code AS before_code, w.code AS after_code, w.line AS wl, w.signature AS ws,
  (1.25::DOUBLE * jaro_winkler_similarity(m.signature, w.signature) + jaro_winkler_similarity(m.body, w.body) + 0.75::DOUBLE * (100000 - abs(m.line - w.line)) / 100000) / 3.0::DOUBLE AS similarity FROM m JOIN w USING (commit, file, kind)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit, file, name, ml ORDER BY similarity DESC, wl, ws) AS r FROM s WHERE similarity > 0.65) WHERE r = 1)"""


@query(f"WITH {RENAMED} SELECT m.commit, m.file, m.parent || '#' || m.signature AS name, t.matched, floor(t.similarity * 1000000 + 0.5) / 1000000 AS similarity FROM m LEFT JOIN t ON m.commit = t.commit AND m.file = t.file AND m.parent || '#' || m.signature = t.name AND m.line = t.ml WHERE t.matched IS NULL OR t.before_code <> t.after_code")
def renamed_executables(spark, d):
    """What became of missing executables: the most similar new one of file and kind above 0.65, or deleted."""
    found = history.renamed(*_versions(spark, d))
    return found.select("commit", "file", "name", "matched", (F.floor(F.col("similarity") * 1_000_000 + 0.5) / 1_000_000).alias("similarity"))


@query(f"WITH {BOTH}, m AS (SELECT b.* FROM b ANTI JOIN a USING (commit, file, local)), w AS (SELECT DISTINCT a.commit, a.file FROM a ANTI JOIN b USING (commit, file, local)) SELECT m.commit, m.file, m.parent || '#' || m.signature AS name, m.code AS before_code FROM m ANTI JOIN w USING (commit, file)")
def deleted_executables(spark, d):
    return history.deleted_when_nothing_new(*_versions(spark, d))


@query("""
WITH t AS (SELECT conv_id, turn, text, role FROM conversations), p AS (SELECT a.conv_id, a.turn, 'import org.junit.Test; @Test ' || a.text AS before, CASE WHEN b.turn % 2 = 0 THEN 'import org.junit.Test; @Test ' || a.text ELSE b.text END AS after FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn FROM p WHERE before <> after""")
def changed_test_classes(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    before = F.concat(F.lit("import org.junit.Test; @Test "), "text")
    files = turns.join(later, ["conv_id", "turn"]).select("conv_id", "turn", before.alias("before"), F.when(F.col("turn") % 2 == 1, before).otherwise(F.col("next")).alias("after"))
    return history.changed_test_classes(files).select("conv_id", "turn")


@query("""
WITH b AS (SELECT o_custkey AS commit, 't' || o_orderkey AS name, o_orderstatus AS code FROM orders), a AS (SELECT o_custkey AS commit, 't' || o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS code FROM orders WHERE o_orderkey % 3 > 0),
q AS (SELECT 't' || l_orderkey AS name, array_to_string(list_sort(list(l_returnflag)), ',') AS types FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), l AS (SELECT 't' || l_orderkey AS name, count(*) AS n FROM lineitem GROUP BY 1)
SELECT commit, name, coalesce(types, '') AS types, CAST(coalesce(n, 0) AS BIGINT) AS n_lines FROM (SELECT commit, name FROM b JOIN a USING (commit, name) WHERE b.code <> a.code) LEFT JOIN q USING (name) LEFT JOIN l USING (name)""")
def changed_tests(spark, d):
    """Tests of both versions whose text differs, with the list of their refactorings (empty if there are none) and their source."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("commit"), F.concat(F.lit("t"), "o_orderkey").alias("name"), "o_orderkey", F.col("o_orderstatus").alias("code"))
    after = orders.where("o_orderkey % 3 > 0").withColumn("code", F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise(F.col("code")))
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("t"), "l_orderkey").alias("name"), "l_returnflag")
    kinds = history.renames_only(lines.withColumnRenamed("l_returnflag", "type"), kinds=("A", "R"))
    changed = history.with_list(history.changed_tests(orders, after), kinds, "name", "type", "types")
    sizes = orders.select("name").distinct().join(lines.groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("string").alias("n_lines"))
    found = history.with_source(changed, sizes, "name", "n_lines")
    return found.select("commit", "name", F.array_join("types", ",").alias("types"), F.col("n_lines").cast("long").alias("n_lines"))


@query("""
WITH p AS (SELECT o_custkey AS commit, o_orderkey AS id FROM orders UNION SELECT o_custkey + 1, o_orderkey FROM orders)
SELECT commit, array_to_string(list_sort(list(id)), ' ') AS ids FROM p GROUP BY commit""")
def repairs_of_commits(spark, d):
    """Repairs under the commits that they start from and end in."""
    repairs = table(spark, d, "orders").select(F.col("o_custkey").alias("bCommit"), (F.col("o_custkey") + 1).alias("aCommit"), F.col("o_orderkey").alias("ID"))
    return history.by_either_commit(repairs).select("commit", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber, l_returnflag <> 'R' AS inside, CASE WHEN l_linestatus = 'O' THEN 'n' END AS node, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT k, bool_and(inside) AS only_tests, count(CASE WHEN NOT (node IS NULL AND n > 1) THEN 1 END) AS n_real FROM l GROUP BY k""")
def root_actions(spark, d):
    """Whether all root actions lie in tests, and the actions that name a node."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_returnflag") != "R").alias("inside"), F.when(F.col("l_linestatus") == "O", "n").alias("srcNode"), F.lit(None).cast("string").alias("dstNode"))
    only = history.only_tests_changed(lines, "k", "inside")
    real = history.real_actions(lines, "k").groupBy(F.col("k").alias("rk")).agg(F.count("*").alias("n_real"))
    return only.join(real, F.col("k") == F.col("rk"), "left").select("k", "only_tests", F.coalesce("n_real", F.lit(0)).alias("n_real"))


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 2 END AS n, 'h' || l_partkey AS hunk FROM lineitem),
f AS (SELECT l_orderkey, arg_min(hunk, (l_linenumber, l_partkey)) AS hunk FROM h WHERE n = 1 GROUP BY l_orderkey) SELECT o_orderkey, coalesce(hunk, 'own') AS hunk FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def hunk_fallback(spark, d):
    """A repair's hunk: that of the first single-hunk change of its test, else its own."""
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("aCommit"), F.lit("t").alias("name"), F.array_repeat(F.concat(F.lit("h"), "l_partkey"), F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(2)).alias("hunks"), F.struct("l_linenumber", "l_partkey").alias("ord"))
    repairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("aCommit"), F.lit("t").alias("name"), F.lit("own").alias("hunk"), "o_orderkey")
    return history.repair_hunk(repairs, changes).select("o_orderkey", "hunk")


@query("""
WITH e AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS value FROM lineitem)
SELECT k, count(*) AS n FROM e WHERE value IS NOT NULL AND line IN (1, 3) GROUP BY k""")
def elements_on_lines(spark, d):
    elements = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("value"))
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("line"))
    return history.elements_on_lines(elements, lines, "k").groupBy("k").agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE c AS (SELECT DISTINCT 's' || (l_suppkey % 20) AS root, 'm' || (l_orderkey % 40) AS src, 'm' || (l_partkey % 40) AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
e AS (SELECT root, src, dst FROM c UNION SELECT DISTINCT root, root, src FROM c WHERE src IN ('m1', 'm2', 'm3')),
b AS (SELECT DISTINCT root, root AS node, 0 AS depth FROM e UNION SELECT b.root, e.dst, b.depth + 1 FROM b JOIN e ON b.root = e.root AND b.node = e.src WHERE b.depth < 41),
m AS (SELECT root, node, min(depth) AS depth FROM b GROUP BY ALL)
SELECT root, node, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY root ORDER BY depth, node) - 1 AS id FROM m""")
def reachable_calls(spark, d):
    """Calls that resolve, followed from every test to the end; nodes numbered by depth and name."""
    lines = table(spark, d, "lineitem")
    calls = lines.select(F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("root"), F.concat(F.lit("m"), F.col("l_orderkey") % 40).alias("src"), F.concat(F.lit("m"), F.col("l_partkey") % 40).alias("dst"), (F.col("l_returnflag") == "R").alias("declared"), (F.col("l_linestatus") == "F").alias("has_body"), F.lit("method").alias("kind"))
    found = history.resolvable_calls(calls).select("root", "src", "dst").distinct()
    graph = found.unionByName(found.where("src IN ('m1', 'm2', 'm3')").select("root", F.col("root").alias("s"), F.col("src").alias("dst")).withColumnRenamed("s", "src").distinct())
    return history.reachable(graph).select("root", "node", F.col("depth").cast("long").alias("depth"), F.col("id").cast("long").alias("id"))


@query("""
WITH e AS (SELECT DISTINCT user_id % 10 AS test, 'C' || (user_id % 30) || CASE WHEN user_id % 2 = 0 THEN '$I' ELSE '' END AS class, event_id % 9 AS line FROM events WHERE event_type <> 'error'),
k AS (SELECT DISTINCT 'C' || (s_suppkey % 20) AS class, 'mod' || (s_suppkey % 20) AS module FROM supplier)
SELECT test, module, e.class, line FROM e JOIN k ON split_part(e.class, '$', 1) = k.class""")
def covered_lines(spark, d):
    """Line events of the project's classes; an inner class stands under its outer one."""
    events = table(spark, d, "events").select((F.col("user_id") % 10).alias("test"), F.concat(F.lit("C"), F.col("user_id") % 30, F.when(F.col("user_id") % 2 == 0, "$I").otherwise("")).alias("class"), (F.col("event_id") % 9).alias("line"), F.when(F.col("event_type") != "error", "LINE_NUMBER").otherwise("x").alias("event"))
    classes = table(spark, d, "supplier").select(F.concat(F.lit("C"), F.col("s_suppkey") % 20).alias("class"), F.concat(F.lit("mod"), F.col("s_suppkey") % 20).alias("module"))
    return history.covered_lines(events, classes)


@query("""
WITH r AS (SELECT o_orderstatus = 'F' AS repaired, o_orderpriority AS verdict, o_orderstatus AS outcome, CASE WHEN o_orderkey % 4 = 0 THEN 'success' ELSE o_orderpriority END AS original FROM orders)
SELECT 'repaired' AS measure, NULL AS value, CAST(sum(repaired::INT) AS BIGINT) AS n, floor(1000.0 * sum(repaired::INT) / count(*) + 0.5) / 10.0 AS pct FROM r
UNION ALL SELECT 'verdict', verdict, count(*), floor(1000.0 * count(*) / sum(count(*)) OVER () + 0.5) / 10.0 FROM r GROUP BY verdict UNION ALL SELECT 'outcome', outcome, count(*), floor(1000.0 * count(*) / sum(count(*)) OVER () + 0.5) / 10.0 FROM r GROUP BY outcome
UNION ALL SELECT 'originally failing', original, count(*), floor(1000.0 * count(*) / sum(count(*)) OVER () + 0.5) / 10.0 FROM r WHERE original <> 'success' GROUP BY original""")
def execution_summary(spark, d):
    runs = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("repaired"), F.col("o_orderpriority").alias("verdict"), F.col("o_orderstatus").alias("outcome"), F.when(F.col("o_orderkey") % 4 == 0, "success").otherwise(F.col("o_orderpriority")).alias("original"))
    return history.execution_summary(runs)


def _processed(spark, d):
    """A commit for every order that is not pending; a change for each line item, a test if returned.

    The change's hunk changes only white space, nothing, or a word, by line status and quantity."""
    line = lambda x: F.array(F.struct(x.alias("line"), F.lit("X").alias("type"), F.lit(1).alias("lineNo")))
    none = F.array().cast(preparation.LINES)
    empty, blank = F.col("l_quantity") < 10, (F.col("l_quantity") >= 10) & (F.col("l_linestatus") == "F")
    target = F.when(blank, F.lit("a  b ")).otherwise("a c")
    hunk = F.struct(F.lit("MODIFY").alias("type"), F.when(empty, none).otherwise(line(F.lit("a b"))).alias("sourceChanges"), F.when(empty, none).otherwise(line(target)).alias("targetChanges"), F.lit(None).cast(f"array<{schemas.ELEMENT}>").alias("sourceElements"), F.lit(None).cast(f"array<{schemas.ELEMENT}>").alias("targetElements"))
    change = F.struct(F.concat(F.lit("f"), "l_linenumber").alias("bPath"), F.lit("x").alias("aPath"), F.lit("n").alias("name"), (F.col("l_returnflag") == "R").alias("is_test_source"), F.array(hunk).alias("hunks"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(change).alias("changes"))
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'").select((F.col("o_orderkey")).alias("k"), (F.col("o_orderkey") % 5).cast("string").alias("project"))
    kind = lines.schema["changes"].dataType
    joined = orders.join(lines.where("k % 6 > 0"), "k", "left").select("project", F.col("k").cast("string").alias("aCommit"), F.coalesce("changes", F.array().cast(kind)).alias("changes"))
    return preparation.preprocess_changes(joined)


COUNTED = """
c AS (SELECT o_orderkey AS k, count(l_orderkey) AS n, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS src, count(CASE WHEN l_returnflag <> 'R' AND l_quantity >= 10 AND l_linestatus <> 'F' THEN 1 END) AS kept, count(CASE WHEN l_returnflag <> 'R' AND (l_quantity < 10 OR l_linestatus = 'F') THEN 1 END) AS blank
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND o_orderkey % 6 > 0 WHERE o_orderstatus <> 'P' GROUP BY o_orderkey)"""


@query(f"WITH {COUNTED}, r AS (SELECT CASE WHEN c.k IS NULL THEN 'Not Found' WHEN n = 0 THEN 'Originally Empty' WHEN src = 0 THEN 'All Test Source' WHEN kept = 0 AND src = n THEN 'Preproccessing' WHEN kept = 0 THEN 'Combination of Both' END AS reason FROM orders LEFT JOIN c ON o_orderkey = c.k) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def empty_change_reasons(spark, d):
    """Why the commits of repairs have no change left."""
    repairs = table(spark, d, "orders").select((F.col("o_orderkey") % 5).cast("string").alias("project"), F.col("o_orderkey").cast("string").alias("aCommit"))
    return preparation.reason_counts(preparation.with_changes(repairs, _processed(spark, d)))


@query(f"WITH {COUNTED}, t AS (SELECT sum(kept) AS kept, sum(blank) AS blank FROM c) SELECT CAST(0 AS BIGINT) AS step_no, 'white space' AS step, CAST(blank AS BIGINT) AS removed, floor(1000.0 * blank / (kept + blank) + 0.5) / 10.0 AS pct, CAST(kept AS BIGINT) AS remaining FROM t UNION ALL SELECT 1, 'empty', 0, 0.0, CAST(kept AS BIGINT) FROM t")
def hunk_counters(spark, d):
    """Hunks that each step removed; hunks without lines have no words to differ in and go with the first."""
    found = preparation.hunk_counters(_processed(spark, d))
    return found.select(F.col("step_no").cast("long").alias("step_no"), "step", F.col("removed").cast("long").alias("removed"), "pct", F.col("remaining").cast("long").alias("remaining"))


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber % 3 AS at, arg_max('m' || l_partkey, (l_linenumber, l_partkey)) AS name FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, m.name AS method, CASE WHEN m.name IS NULL THEN 'class' ELSE 'method' END AS scope FROM lineitem l LEFT JOIN m ON l.l_orderkey = m.l_orderkey AND l.l_linenumber % 3 = m.at""")
def labelled_hunks(spark, d):
    """Class hunks named after the last method hunk at their place."""
    lines = table(spark, d, "lineitem")
    place = F.array(F.struct(F.lit("x").alias("line"), F.lit("X").alias("type"), (F.col("l_linenumber") % 3).cast("int").alias("lineNo")))
    hunk = F.struct(place.alias("sourceChanges"), place.alias("targetChanges"))
    keys = [F.lit("p").alias("project"), F.col("l_orderkey").cast("string").alias("aCommit"), F.lit("f").alias("path"), hunk.alias("hunk")]
    classes = lines.select("l_orderkey", "l_linenumber", *keys)
    methods = lines.where("l_suppkey % 2 = 0").select(*keys, F.concat(F.lit("m"), "l_partkey").alias("name"), F.struct("l_linenumber", "l_partkey").alias("ord"))
    return preparation.label_hunks(classes, methods).select("l_orderkey", "l_linenumber", F.col("methodName").alias("method"), "scope")


@query("""
WITH h AS (SELECT o_orderkey AS id, l_returnflag AS kind FROM orders JOIN lineitem ON l_suppkey = o_custkey WHERE l_partkey % 10 = o_orderkey % 10 AND l_partkey % 7 = o_orderkey % 7)
SELECT id, array_to_string(list_sort(list_distinct(list(kind))), ',') AS trivial FROM h GROUP BY id""")
def trivial_types(spark, d):
    """Renames whose old name the test used before and whose new name it uses after."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    repairs = orders.select(F.col("o_orderkey").alias("ID"), F.concat(F.lit("t"), "o_orderkey").alias("name"), F.concat(F.lit("b"), "o_custkey").alias("bCommit"), F.concat(F.lit("a"), "o_custkey").alias("aCommit"))
    renames = lines.select(F.concat(F.lit("a"), "l_suppkey").alias("commit"), F.col("l_returnflag").alias("refactoringType"), F.concat(F.lit("o"), F.col("l_partkey") % 10).alias("originalName"), F.concat(F.lit("n"), F.col("l_partkey") % 7).alias("newName"))
    used = lambda side, mark, n: repairs.select(F.col(side).alias("commit"), F.col("name").alias("test"), F.concat(F.lit(mark), F.col("ID") % n).alias("element"))
    found = encoders.trivial_types(repairs, renames, used("bCommit", "o", 10), used("aCommit", "n", 7))
    return found.select(F.col("ID").alias("id"), F.array_join("trivial", ",").alias("trivial"))


@query("""
WITH k AS (SELECT url AS path FROM pages GROUP BY url HAVING count(*) > 1), c AS (SELECT a.page_id, a.url AS b, z.url AS a FROM pages a LEFT JOIN pages z ON z.page_id = a.page_id + 1)
SELECT page_id, (b IN (SELECT path FROM k) OR coalesce(a IN (SELECT path FROM k), false) OR contains(b, '/en/') OR coalesce(contains(a, '/en/'), false)) AS is_test FROM c""")
def test_source_flag(spark, d):
    """A change is a test's if either path is a known test's or says so itself."""
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("bPath"))
    later = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("bPath").alias("aPath"))
    known = pages.groupBy(F.col("bPath").alias("path")).agg(F.count("*").alias("n")).where("n > 1")
    return history.flag_test_sources(pages.join(later, "page_id", "left"), known, "/en/").select("page_id", F.col("is_test_source").alias("is_test"))


@query("SELECT o_custkey AS commit, CAST(o_orderkey AS VARCHAR) AS file, o_orderstatus AS before_code FROM orders WHERE o_orderkey % 3 <> 1 AND (o_orderkey % 3 = 2 OR o_orderstatus <> 'F')")
def class_changes(spark, d):
    """Types of files in both versions whose text differs."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("commit"), F.col("o_orderkey").cast("string").alias("file"), F.lit("T").alias("name"), F.col("o_orderstatus").alias("code"), "o_orderkey")
    after = orders.where("o_orderkey % 3 <> 1").withColumn("code", F.when(F.col("o_orderkey") % 3 == 2, "new").otherwise("F"))
    return history.class_changes(orders, after).select("commit", "file", "before_code")


USED = """SELECT l_suppkey AS commit, l_orderkey AS user, l_linenumber AS slot, CASE WHEN l_partkey % 3 = 0 THEN 'method' ELSE 'class' END AS kind,
CASE WHEN l_partkey % 3 = 0 THEN 'q.K#m' || l_partkey || '(int)' ELSE 'q.C' || l_partkey END AS was, CASE WHEN l_partkey % 3 = 0 THEN 'q.K#' ELSE CASE WHEN l_partkey % 4 = 1 THEN 'r.' ELSE 'q.' END || 'C' END
|| CASE l_partkey % 4 WHEN 2 THEN CASE WHEN l_partkey % 3 = 0 THEN 'm' ELSE '' END || l_partkey WHEN 3 THEN CASE WHEN l_quantity < 25 THEN 's' || (l_partkey % 7) ELSE 't' || (l_partkey % 5) END ELSE 'n' || l_partkey END || CASE WHEN l_partkey % 3 = 0 THEN '(int)' ELSE '' END AS becomes FROM lineitem"""


@query(f"""
WITH RECURSIVE u AS ({USED}), p AS (SELECT commit, user, slot, min(was) AS o, min(becomes) AS n FROM u GROUP BY ALL HAVING count(DISTINCT was) = 1 AND count(DISTINCT becomes) = 1),
b AS (SELECT DISTINCT commit, kind, was AS name FROM u), a AS (SELECT DISTINCT commit, kind, becomes AS name FROM u), gone AS (FROM b EXCEPT FROM a), gained AS (FROM a EXCEPT FROM b),
v AS (SELECT p.commit, gone.kind, o, n, count(*) AS votes FROM p JOIN gone ON gone.commit = p.commit AND gone.name = o JOIN gained ON gained.commit = p.commit AND gained.name = n AND gained.kind = gone.kind GROUP BY ALL),
w AS (SELECT *, false AS m FROM v UNION ALL
SELECT commit, kind, o, n, votes, row_number() OVER (PARTITION BY commit, kind, o ORDER BY votes DESC, n) = 1 AND row_number() OVER (PARTITION BY commit, kind, n ORDER BY votes DESC, o) = 1 AS m
FROM (SELECT *, bool_or(m) OVER (PARTITION BY commit, kind, o) AS mo, bool_or(m) OVER (PARTITION BY commit, kind, n) AS mn FROM w) WHERE NOT mo AND NOT mn)
SELECT commit, CASE WHEN kind = 'method' THEN 'RENAME_METHOD' WHEN split_part(o, '.', 1) = split_part(n, '.', 1) THEN 'RENAME_CLASS' ELSE 'MOVE_RENAME_CLASS' END AS refactoringType, o AS originalName, n AS newName, votes FROM w WHERE m AND split_part(o, '.', 2) <> split_part(n, '.', 2)""")
def mined_renames(spark, d):
    """Renames told from the line items whose part has another name in the second version; some new names are fought for."""
    table(spark, d, "lineitem").createOrReplaceTempView("patchloom_lineitem")
    used = spark.sql(USED.replace("FROM lineitem", "FROM patchloom_lineitem"))
    elements = [used.select("commit", "kind", F.col(side).alias("name")) for side in ("was", "becomes")]
    uses = [used.select("commit", "user", "slot", F.col(side).alias("name")) for side in ("was", "becomes")]
    return renames.mined_renames(*elements, *[u.withColumn("user", F.col("user").cast("string")) for u in uses])


def _small_files(side: str) -> str:
    return f"SELECT * REPLACE ('f' || (p_partkey // 4) AS file) FROM ({side})"


SMALL = f"b AS (SELECT *, {LOCAL} FROM ({_small_files(BEFORE)})), a AS (SELECT *, {LOCAL} FROM ({_small_files(AFTER)}))"


@query(f"WITH {SMALL}, m AS (SELECT b.* FROM b ANTI JOIN a USING (commit, file, local)), w AS (SELECT DISTINCT a.commit, a.file FROM a ANTI JOIN b USING (commit, file, local)) SELECT m.commit, m.file, m.parent || '#' || m.signature AS name, m.code AS before_code FROM m ANTI JOIN w USING (commit, file)")
def deleted_from_small_files(spark, d):
    """Executables that vanished from files of few parts, of which many gained none."""
    table(spark, d, "part").createOrReplaceTempView("patchloom_part")
    file = F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 4))
    sides = [spark.sql(side.replace("FROM part", "FROM patchloom_part")).withColumn("file", file).drop("p_partkey") for side in (BEFORE, AFTER)]
    return history.deleted_when_nothing_new(*sides)
