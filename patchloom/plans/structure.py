"""Queries over trees and data flow: page markup as node tables, folded subtrees, differences, reaching definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators import dataflow, metrics, trees
from patchloom.plans.evaluation import _BLEU as BLEU
from patchloom.plans.evaluation import _WBLEU as WEIGHTED
from patchloom.plans.evaluation import CORPUS
from patchloom.plans.registry import query, spread, table
from patchloom.plans.textual import KEY_WORDS, WORDS, _pairs
from patchloom.storage import materialize

#: Elements without content.
VOID = ["meta", "br", "link", "img", "input", "hr"]


#: Pages of a task that makes their node tables, and nodes of two pages that one task compares by itself; larger ones are compared by joins.
PAGES, HELD = 2_500, 20_000


def page_nodes(spark, d, whole: bool = False) -> DataFrame:
    """The markup of every page as a node table: elements by name, text as ``#text``, comments as ``#note``.

    With ``whole`` the pages are dealt once, and their windows need no other exchange; without values, nodes are exchanged for less."""
    pages = table(spark, d, "pages").select("page_id", "html")
    pages = spread(pages, "page_id", rows=PAGES) if whole else pages
    parts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<[^>]*>|[^<]+"), F.lit(0))).alias("node", "part"))
    name = F.lower(F.regexp_extract("part", "^<([a-zA-Z0-9]+)", 1))
    kind = F.when(F.col("part").startswith("<!"), "#note").when(F.col("part").startswith("<"), name).otherwise("#text")
    step = F.when(F.col("part").startswith("</"), -1).when(F.col("kind").startswith("#") | F.col("kind").isin(VOID), 0).otherwise(1)
    tokens = parts.withColumn("kind", kind).select(F.col("page_id").alias("tree"), F.col("node").cast("long").alias("node"), step.alias("step"), "kind", F.trim("part").alias("value"))
    return trees.nested(tokens)


NODES = f"""parts AS (SELECT page_id AS tree, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS node FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^<]+') AS p FROM pages)),
tokens AS (SELECT *, CASE WHEN part LIKE '</%' THEN -1 WHEN kind LIKE '#%' OR kind IN {tuple(VOID)} THEN 0 ELSE 1 END AS step
  FROM (SELECT *, CASE WHEN part LIKE '<!%' THEN '#note' WHEN part LIKE '<%' THEN lower(regexp_extract(part, '^<([a-zA-Z0-9]+)', 1)) ELSE '#text' END AS kind FROM parts)),
levels AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY tree ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM tokens),
asks AS (SELECT c.tree, c.node, c.kind, c.part, max(o.node) AS parent FROM levels c LEFT JOIN levels o ON o.tree = c.tree AND o.step = 1 AND o.level = c.level - 1 AND o.node < c.node WHERE c.step >= 0 GROUP BY ALL),
nodes AS (SELECT *, row_number() OVER (PARTITION BY tree, parent ORDER BY node) - 1 AS place FROM asks)"""
#: From the deepest level up; a node joins its folded children (the texts of pages' subtrees are short enough to stay whole in both).
FOLDED = f"""{NODES}, depths AS (SELECT tree, node, parent, place, kind, 0 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.tree, n.node, n.parent, n.place, n.kind, depth + 1 FROM nodes n JOIN depths d ON n.tree = d.tree AND n.parent = d.node),
folds AS (SELECT tree, node, parent, place, depth, '(' || kind || ')' AS text, 1 AS size, 1 AS height FROM depths WHERE depth = (SELECT max(depth) FROM depths)
  UNION ALL SELECT d.tree, d.node, d.parent, d.place, d.depth, '(' || d.kind || coalesce(' ' || f.inner_text, '') || ')', 1 + coalesce(f.under, 0), 1 + coalesce(f.lower, 0)
  FROM (SELECT DISTINCT depth - 1 AS depth FROM folds WHERE depth > 0) now JOIN depths d ON d.depth = now.depth
  LEFT JOIN (SELECT tree, parent, string_agg(text, ' ' ORDER BY place) AS inner_text, sum(size) AS under, max(height) AS lower FROM folds GROUP BY tree, parent) f ON f.tree = d.tree AND f.parent = d.node)"""


@query(f"WITH RECURSIVE {FOLDED} SELECT tree AS page_id, node, size::BIGINT AS size, height::INT AS height, md5(text) AS digest FROM folds")
def subtree_digests(spark, d):
    """Size, height and digest of the text of every subtree of every page."""
    done = trees.folded(trees.with_depth(page_nodes(spark, d)), longest=1 << 20)
    return done.select(F.col("tree").alias("page_id"), "node", "size", "height", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE {FOLDED}, own AS (SELECT tree, text FROM folds WHERE height > 1 OR parent IS NULL)
SELECT a.tree AS page_id, sum((b.text IS NOT NULL)::INT)::BIGINT AS matched, count(*) AS total FROM own a LEFT JOIN (SELECT DISTINCT tree - 1 AS tree, text FROM own) b ON a.tree = b.tree AND a.text = b.text GROUP BY a.tree""")
def subtree_match(spark, d):
    """Subtrees of a page that the next page has too."""
    own = trees.subtrees(page_nodes(spark, d))
    found = metrics.tree_match(own, own.withColumn("tree", F.col("tree") - 1), ["tree"], "text")
    return found.select(F.col("tree").alias("page_id"), F.col("matched").cast("long").alias("matched"), "total")


@query(None)
def tree_difference(spark, d):
    """What turns a page's markup into that of the next page: rows of each action and kind."""
    nodes = materialize(page_nodes(spark, d, whole=True), "page-nodes")
    last = nodes.agg(F.max("tree")).first()[0]
    pairs = trees.tree_difference(nodes.where(F.col("tree") < F.lit(last)), nodes.where("tree > 0").withColumn("tree", F.col("tree") - 1), held=HELD)
    return pairs.groupBy(F.col("tree").alias("page_id"), "action", "kind").agg(F.count("*").alias("n"), F.count_if("root").alias("n_root"))


#: Statements, and turns, of a task whose routines are made and followed where they are.
STATEMENTS, ROUTINES = 250_000, 2_500


def _statements(spark, d) -> tuple[DataFrame, DataFrame]:
    """An order as a routine: line numbers are blocks, line items statements that compute a supplier's variable from those of
    part and quantity. Blocks follow each other; a returned item branches over the next block, an accepted one jumps back."""
    lines = spread(table(spark, d, "lineitem"), "l_orderkey", rows=STATEMENTS)
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    items = lines.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("block"), rank.alias("stmt"), "l_returnflag", "l_suppkey", "l_partkey", "l_quantity")
    variable = lambda c: F.concat(F.lit("v"), F.col(c).cast("long") % 5)
    each = [("def", "l_suppkey"), ("use", "l_partkey"), ("use", "l_quantity")]
    occurrences = items.select("unit", "block", "stmt", F.explode(F.array(*[F.struct((F.col("stmt").cast("long") * 3 + i).alias("pos"), F.lit(role).alias("role"), variable(c).alias("name")) for i, (role, c) in enumerate(each)])).alias("o"))
    blocks = items.groupBy("unit", "block").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("skips"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("loops"))
    order = Window.partitionBy("unit").orderBy("block")
    goals = F.array(F.lead("block").over(order), F.when(F.col("skips") == 1, F.lead("block", 2).over(order)), F.when(F.col("loops") == 1, F.min("block").over(Window.partitionBy("unit"))))
    flow = blocks.select("unit", F.col("block").alias("src"), goals.alias("goals")).select("unit", "src", F.explode("goals").alias("dst")).where("dst IS NOT NULL").distinct()
    return occurrences.select("unit", "block", "stmt", "o.*"), flow


REACH = """last AS (SELECT unit, block, name, max(pos) AS def_pos FROM occ WHERE role = 'def' GROUP BY ALL),
facts AS (SELECT l.unit, f.dst AS block, l.name, l.def_pos FROM last l JOIN flow f ON f.unit = l.unit AND f.src = l.block
  UNION SELECT x.unit, f.dst, x.name, x.def_pos FROM facts x JOIN flow f ON f.unit = x.unit AND f.src = x.block LEFT JOIN last l ON l.unit = x.unit AND l.block = x.block AND l.name = x.name WHERE l.name IS NULL),
used AS (SELECT u.unit, u.block, u.pos, u.name, max(o.pos) AS own FROM occ u LEFT JOIN occ o ON o.role = 'def' AND o.unit = u.unit AND o.block = u.block AND o.name = u.name AND o.stmt < u.stmt WHERE u.role = 'use' GROUP BY ALL),
reached AS (SELECT u.unit, u.pos, u.name, coalesce(own, def_pos) AS def_pos FROM used u LEFT JOIN facts x ON own IS NULL AND x.unit = u.unit AND x.block = u.block AND x.name = u.name)"""


@query(f"""WITH RECURSIVE items AS (SELECT l_orderkey AS unit, l_linenumber AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS stmt, l_returnflag, l_suppkey, l_partkey, l_quantity FROM lineitem),
occ AS (SELECT unit, block, stmt, stmt * 3 AS pos, 'def' AS role, 'v' || (l_suppkey % 5) AS name FROM items UNION ALL SELECT unit, block, stmt, stmt * 3 + 1, 'use', 'v' || (l_partkey % 5) FROM items UNION ALL SELECT unit, block, stmt, stmt * 3 + 2, 'use', 'v' || (l_quantity::BIGINT % 5) FROM items),
blocks AS (SELECT unit, block, max((l_returnflag = 'R')::INT) AS skips, max((l_returnflag = 'A')::INT) AS loops FROM items GROUP BY ALL),
ways AS (SELECT unit, block AS src, lead(block) OVER w AS a, CASE WHEN skips = 1 THEN lead(block, 2) OVER w END AS b, CASE WHEN loops = 1 THEN min(block) OVER (PARTITION BY unit) END AS c FROM blocks WINDOW w AS (PARTITION BY unit ORDER BY block)),
flow AS (SELECT DISTINCT unit, src, dst FROM (SELECT unit, src, unnest([a, b, c]) AS dst FROM ways) WHERE dst IS NOT NULL), {REACH}
SELECT unit, pos, name, def_pos FROM reached""")
def reaching_definitions(spark, d):
    """The definitions that reach each use, in routines with branches and loops made of line items."""
    return dataflow.reaching(*_statements(spark, d))


def turn_nodes(spark, d) -> DataFrame:
    """Turns as trees: a ``text`` of ``line`` nodes, whose ``group`` nodes have three words each; a word's kind is its length."""
    text = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("tree"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    lines = text.select("tree", "line", metrics.tokens(F.col("t")).alias("w")).where(F.size("w") > 0)
    own = F.col("line").cast("long") * 100_000 + 1
    words = lines.select("tree", own.alias("line"), F.posexplode("w").alias("i", "w"))
    words = words.select("tree", "line", F.expr("i div 3").cast("int").alias("group"), (F.col("i") % 3).alias("place"), "w").withColumn("own", F.col("line") + 1 + F.col("group") * 4)
    top = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("tree"), F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("place"), F.lit("text").alias("kind"))
    inner = lines.select("tree", own.alias("node"), F.lit(0).cast("long").alias("parent"), F.col("line").alias("place"), F.lit("line").alias("kind"))
    groups = words.where("place = 0").select("tree", F.col("own").alias("node"), F.col("line").alias("parent"), F.col("group").alias("place"), F.lit("group").alias("kind"))
    leaves = words.select("tree", (F.col("own") + 1 + F.col("place")).alias("node"), F.col("own").alias("parent"), "place", F.concat(F.lit("w"), F.length("w")).alias("kind"))
    return top.unionByName(inner).unionByName(groups).unionByName(leaves).withColumn("value", F.lit(None).cast("string"))


def turn_flow(spark, d) -> DataFrame:
    """Normal edges ``k, edge`` of turns read as routines: a line is a block whose first word is computed from the others; an even
    number of words branches over the next line, a multiple of five jumps back to the first."""
    turns = spread(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit"), "text"), "unit", rows=ROUTINES)
    text = turns.select("unit", F.posexplode(F.split("text", "\n")).alias("block", "t"))
    lines = text.select("unit", "block", metrics.tokens(F.col("t")).alias("w")).where(F.size("w") > 0)
    words = lines.select("unit", "block", F.col("block").alias("stmt"), F.posexplode("w").alias("i", "name"))
    occurrences = words.select("unit", "block", "stmt", (F.col("block").cast("long") * 100_000 + F.col("i")).alias("pos"), F.when(F.col("i") == 0, "def").otherwise("use").alias("role"), "name")
    order = Window.partitionBy("unit").orderBy("block")
    goals = F.array(F.lead("block").over(order), F.when(F.size("w") % 2 == 0, F.lead("block", 2).over(order)), F.when(F.size("w") % 5 == 0, F.min("block").over(Window.partitionBy("unit"))))
    flow = lines.select("unit", F.col("block").alias("src"), goals.alias("goals")).select("unit", "src", F.explode("goals").alias("dst")).where("dst IS NOT NULL").distinct()
    edges = dataflow.flow_edges(occurrences, flow).withColumnRenamed("unit", "k")
    return metrics.normal_flow(metrics.merged_flow(edges, ["k"]), ["k"])


#: The normal edges of every turn (``g``), and the subtrees of every turn (``own``).
TURNS = f"""lines AS (SELECT unit, line AS block, w FROM (SELECT unit, line, {WORDS.format('t')} AS w FROM (SELECT conv_id * 1000 + turn AS unit, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations)) WHERE len(w) > 0),
words AS (SELECT unit, block, block AS stmt, unnest(w) AS name, generate_subscripts(w, 1) - 1 AS i FROM lines),
occ AS (SELECT unit, block, stmt, block * 100000 + i AS pos, CASE WHEN i = 0 THEN 'def' ELSE 'use' END AS role, name FROM words),
ways AS (SELECT unit, block AS src, lead(block) OVER w AS a, CASE WHEN len(lines.w) % 2 = 0 THEN lead(block, 2) OVER w END AS b, CASE WHEN len(lines.w) % 5 = 0 THEN min(block) OVER (PARTITION BY unit) END AS c FROM lines WINDOW w AS (PARTITION BY unit ORDER BY block)),
flow AS (SELECT DISTINCT unit, src, dst FROM (SELECT unit, src, unnest([a, b, c]) AS dst FROM ways) WHERE dst IS NOT NULL), {REACH},
dep AS (SELECT unit, pos, name, 'comesFrom' AS kind, def_pos AS source_pos, name AS source_name FROM reached WHERE def_pos IS NOT NULL
  UNION ALL SELECT d.unit, d.pos, d.name, 'computedFrom', u.pos, u.name FROM occ d JOIN occ u ON d.unit = u.unit AND d.block = u.block AND u.role = 'use' WHERE d.role = 'def'),
met AS (SELECT unit, name, min(m) AS m FROM (SELECT unit, source_name AS name, [pos, 0, source_pos] AS m FROM dep UNION ALL SELECT unit, name, [pos, 1, 0] FROM dep UNION ALL SELECT unit, source_name, [source_pos, 1, 0] FROM dep) GROUP BY ALL),
called AS (SELECT unit, name, 'var_' || (row_number() OVER (PARTITION BY unit ORDER BY m) - 1) AS called FROM met),
occurring AS (SELECT unit, pos, name FROM dep UNION SELECT unit, source_pos, source_name FROM dep),
g AS (SELECT o.unit, a.called || ' ' || coalesce(any_value(d.kind), 'comesFrom') || ' ' || coalesce(string_agg(b.called, ' ' ORDER BY d.source_pos), '') AS edge
  FROM occurring o JOIN called a ON a.unit = o.unit AND a.name = o.name LEFT JOIN dep d ON d.unit = o.unit AND d.pos = o.pos LEFT JOIN called b ON b.unit = d.unit AND b.name = d.source_name GROUP BY o.unit, o.pos, a.called),
groups AS (SELECT unit, block, list_transform(range(0, len(w), 3), lambda i: '(group ' || array_to_string(list_transform(list_slice(w, i + 1, i + 3), lambda x: '(w' || length(x) || ')'), ' ') || ')') AS texts FROM lines),
line_trees AS (SELECT unit, block, '(line ' || array_to_string(texts, ' ') || ')' AS text FROM groups),
own AS (SELECT unit, unnest(texts) AS text FROM groups UNION ALL SELECT unit, text FROM line_trees UNION ALL SELECT conv_id * 1000 + turn, '(text' || coalesce(t, '') || ')' FROM conversations LEFT JOIN (SELECT unit, ' ' || string_agg(text, ' ' ORDER BY block) AS t FROM line_trees GROUP BY unit) z ON z.unit = conv_id * 1000 + turn)"""


@query(f"WITH RECURSIVE {TURNS} SELECT unit AS k, edge, count(*) AS n FROM g GROUP BY ALL")
def turn_data_flow(spark, d):
    """The normal data flow of every turn, from reaching definitions."""
    return turn_flow(spark, d).groupBy("k", "edge").agg(F.count("*").alias("n"))


_SIX = "floor({0} * 1000000 + 0.5) / 1000000"


@query(f"""WITH RECURSIVE {TURNS}, {CORPUS}, keys AS (SELECT conv_id * 1000 + turn AS k FROM p),
syn AS (SELECT sum((h.text IS NOT NULL)::INT) / count(*) AS syntax FROM keys JOIN own r ON r.unit = k + 1 LEFT JOIN (SELECT DISTINCT unit, text FROM own) h ON h.unit = k AND h.text = r.text),
fa AS (SELECT k, edge, count(*) AS a FROM keys JOIN g ON g.unit = k + 1 GROUP BY ALL), fb AS (SELECT k, edge, count(*) AS b FROM keys JOIN g ON g.unit = k GROUP BY ALL),
dfm AS (SELECT sum(least(a, coalesce(b, 0))) / sum(a) AS flowing FROM fa LEFT JOIN fb USING (k, edge))
SELECT {_SIX.format(BLEU)} AS bleu, {_SIX.format(WEIGHTED)} AS weighted, {_SIX.format('syntax')} AS syntax, {_SIX.format('flowing')} AS data_flow, {_SIX.format(f'(0.25 * {BLEU} + 0.25 * {WEIGHTED} + 0.25 * syntax + 0.25 * flowing)')} AS code_bleu FROM t, l, wt, syn, dfm""")
def code_bleu_whole(spark, d):
    """The sum of four scores over user turns (hypotheses) and the answers that follow (references): word grams, weighted
    grams, subtrees folded from node tables and data flow from reaching definitions."""
    pairs = _pairs(spark, d)
    keys = pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    both = lambda rows, key: (rows.join(keys, F.col(key) == F.col("k") + 1, "left_semi").withColumn(key, F.col(key) - 1), rows.join(keys, F.col(key) == F.col("k"), "left_semi"))
    texts = materialize(trees.subtrees(turn_nodes(spark, d)), "turn-trees")
    matched = metrics.tree_match(*both(texts, "tree"), ["tree"], "text").agg(F.sum("matched").alias("m"), F.sum("total").alias("t"))
    edges = materialize(turn_flow(spark, d).withColumnRenamed("k", "unit"), "turn-flow")
    flowing = metrics.flow_match(*both(edges, "unit"), ["unit"]).agg(F.sum("matched").alias("m"), F.sum("total").alias("t"))
    rate = lambda frame, name: frame.select(metrics.match_rate(F.coalesce("m", F.lit(0)), F.coalesce("t", F.lit(0))).alias(name), F.lit(1).alias("one"))
    scores = metrics.corpus_scores(pairs, ["conv_id", "turn"], "hyp", "ref", KEY_WORDS).select("bleu", "weighted", F.lit(1).alias("one"))
    joined = scores.join(rate(matched, "syntax"), "one").join(rate(flowing, "data_flow"), "one")
    total = metrics.code_bleu(F.col("bleu"), F.col("weighted"), F.col("syntax"), F.col("data_flow"))
    six = lambda c: F.floor(c * 1_000_000 + 0.5) / 1_000_000
    return joined.select(*(six(F.col(c)).alias(c) for c in ("bleu", "weighted", "syntax", "data_flow")), six(total).alias("code_bleu"))
