"""Ordered trees as node tables: nesting, paths, folded subtrees, and the difference of two trees.

A node table has a row for each node: ``tree`` (key), ``node`` (ids ascend in document order inside a tree), ``parent``
(null for a root; several roots are allowed), ``place`` (0, 1, ... among its siblings), ``kind``, ``value`` (may be null).
Every step is joins and aggregates over all trees at once, and no task holds a tree; only :func:`tree_difference` compares trees of a
bounded number of nodes one at a time, where they are. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.forests import ACTIONS, INSERT, MOVE, Forest, difference
from patchloom.functions.forests import kept_order as _kept_order
from patchloom.storage import materialize, remove

NODE = ["tree", "node", "parent", "place", "kind", "value"]
#: Children folded together at most, and characters of a subtree's text before its digest stands for it.
FAN, LONGEST = 1024, 4096
#: Nodes of a task that compares trees one at a time, and kinds of actions and of their parents that it hands on together, about.
TASK_NODES, HANDED = 250_000, 1 << 20


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side that joins do not broadcast: a scratch table's files are far smaller than its rows, so the size of the
    files would send tables that grow with the input through the driver."""
    return df.hint("merge")


def _as(df: DataFrame, prefix: str, *names: str) -> DataFrame:
    """``names`` of ``df`` under a prefix, for a shuffled join with another copy of it."""
    return _shuffled(df.select(*(F.col(n).alias(prefix + n) for n in names)))


def with_paths(nodes: DataFrame) -> DataFrame:
    """Adds ``path``: the ancestors from the nearest to the root, and ``depth``, its size.

    Pointer doubling: a round appends the path of the farthest known ancestor, so rounds grow with the logarithm of
    the depth, and deep trees cost no more rounds than that."""
    now = nodes.withColumn("path", F.when(F.col("parent").isNull(), F.array().cast("array<long>")).otherwise(F.array("parent")))
    now, reach = materialize(now, "tree-paths"), 1
    while not now.where(F.size("path") >= reach).isEmpty():
        far = _as(now, "f_", "tree", "node", "path")
        joined = now.join(far, (F.col("tree") == F.col("f_tree")) & (F.get("path", F.size("path") - 1) == F.col("f_node")) & (F.size("path") == reach), "left")
        now = materialize(joined.withColumn("path", F.concat("path", F.coalesce("f_path", F.array().cast("array<long>")))).select(*nodes.columns, "path"), "tree-paths")
        reach *= 2
    return now.withColumn("depth", F.size("path"))


def with_depth(nodes: DataFrame) -> DataFrame:
    """Nodes with their ``depth`` alone, for a fold by kinds: neither values nor paths travel through its rounds.

    The doubling of :func:`with_paths`, but a node keeps only its farthest known ancestor and how far that is."""
    slim = ["tree", "node", "parent", "place", "kind"]
    now = materialize(nodes.select(*slim, F.col("parent").alias("far"), F.col("parent").isNotNull().cast("int").alias("depth")), "tree-depths")
    while not now.where("far IS NOT NULL").isEmpty():
        joined = now.join(_as(now, "f_", "tree", "node", "far", "depth"), (F.col("tree") == F.col("f_tree")) & (F.col("far") == F.col("f_node")), "left")
        last, now = now, materialize(joined.select(*slim, F.col("f_far").alias("far"), (F.col("depth") + F.coalesce("f_depth", F.lit(0))).alias("depth")), "tree-depths")
        remove(last)
    return now.drop("far")


def _kept_short(text: Column, longest: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.lit("#"), F.md5(text.cast("binary")))).otherwise(text)


def folded(nodes: DataFrame, label: Column | None = None, longest: int = LONGEST, fan: int = FAN) -> DataFrame:
    """Adds to nodes with paths ``text``, ``size`` (nodes of the subtree) and ``height`` (1 for a leaf).

    ``text`` is ``(label child child ...)`` with the children in order, so equal texts are equal subtrees. Levels are
    folded from the deepest up, one join each. Text over ``longest`` characters is replaced by ``#`` and its MD5, and
    more than ``fan`` children are joined in groups first, so neither depth nor width makes a long text or list."""
    label = F.col("kind") if label is None else label
    now = materialize(nodes.withColumn("label", label), "tree-levels", by="depth")
    deepest = now.agg(F.max("depth")).first()[0]
    below, done = None, []
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = now.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"inner": F.lit(""), "under": F.lit(0).cast("long"), "lower": F.lit(0)})
        else:
            group = F.expr(f"place div {fan}")
            parts = below.groupBy("tree", "parent", group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("own"), F.sum("size").alias("under"), F.max("height").alias("lower"))
            parts = parts.withColumn("own", _kept_short(F.array_join(F.transform("own", lambda x: x["text"]), " "), longest))
            whole = parts.groupBy(F.col("tree").alias("c_tree"), F.col("parent").alias("c_parent")).agg(F.array_sort(F.collect_list(F.struct("g", "own"))).alias("parts"), F.sum("under").alias("under"), F.max("lower").alias("lower"))
            whole = whole.select("c_tree", "c_parent", F.concat(F.lit(" "), F.array_join(F.transform("parts", lambda x: x["own"]), " ")).alias("inner"), "under", "lower")
            level = level.join(_shuffled(whole), (F.col("tree") == F.col("c_tree")) & (F.col("node") == F.col("c_parent")), "left").drop("c_tree", "c_parent")
            level = level.na.fill({"inner": "", "under": 0, "lower": 0})
        text = F.concat(F.lit("("), "label", "inner", F.lit(")"))
        level = level.select(*nodes.columns, _kept_short(text, longest).alias("text"), (F.col("under") + 1).alias("size"), (F.col("lower") + 1).alias("height"))
        below = materialize(level, "tree-level")
        done.append(below)
    if not done:
        return nodes.withColumns({"text": F.lit(""), "size": F.lit(0).cast("long"), "height": F.lit(0)}).limit(0)
    return reduce(DataFrame.unionByName, done)


def subtrees(nodes: DataFrame) -> DataFrame:
    """``tree, text`` of every root and every node with children: what :func:`metrics.tree_match` compares."""
    return folded(with_depth(nodes)).where((F.col("height") > 1) | F.col("parent").isNull()).select("tree", "text")


def nested(tokens: DataFrame) -> DataFrame:
    """The node table of ``tree, node, step, kind, value`` tokens in document order (``node`` ascends): step 1 opens a node,
    0 is a leaf, -1 closes the innermost open node and is none itself.

    A node's parent is the last one opened a level above it; found by a running maximum over the rows of that level, where a
    node that opens has a second row. Tokens that are dealt by ``tree`` are not exchanged again."""
    before = Window.partitionBy("tree").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    level = tokens.withColumn("level", F.coalesce(F.sum("step").over(before), F.lit(0))).where("step >= 0")
    roles = F.when(F.col("step") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    rows = level.withColumn("own", F.explode(roles))
    own = F.col("own")
    rows = rows.select("tree", "node", (F.col("level") - own.cast("int")).alias("key"), F.when(~own, F.col("node")).alias("open"), *(F.when(own, F.col(c)).alias(c) for c in ("kind", "value")), "own")
    above = Window.partitionBy("tree", "key").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("parent", F.max("open").over(above)).where("own")
    place = F.row_number().over(Window.partitionBy("tree", "parent").orderBy("node")) - 1
    return found.select("tree", "node", "parent", place.alias("place"), "kind", "value")


# ---- difference ----------------------------------------------------------------------------------------------------


def _prepared(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both forests with the digest of each subtree (kinds and values), path, size, height and ``ord``, the place in
    document order. They are folded together, so their levels share rounds."""
    label = F.concat_ws(" ", "kind", F.md5(F.coalesce("value", F.lit("")).cast("binary")), F.col("value").isNull().cast("string"))
    sided = [df.select(F.struct(F.lit(i).alias("side"), "tree").alias("tree"), *NODE[1:]) for i, df in enumerate((before, after))]
    done = folded(with_paths(sided[0].unionByName(sided[1])), label).withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")
    done = materialize(done.withColumn("ord", F.row_number().over(Window.partitionBy("tree").orderBy("node"))), "tree-nodes")
    return tuple(done.where(F.col("tree.side") == i).withColumn("tree", F.col("tree.tree")) for i in (0, 1))


def _tops(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """``tree, digest, k, ord, size``: the nodes of ``left`` (not yet covered) whose subtree is on the right too but whose
    parent's is not, numbered by digest in document order."""
    shared = left.where(F.col("height") >= least).join(_shuffled(_as(right, "r_", "tree", "digest").distinct()), (F.col("tree") == F.col("r_tree")) & (F.col("digest") == F.col("r_digest")), "left_semi")
    tops = shared.join(_as(shared, "p_", "tree", "node"), (F.col("tree") == F.col("p_tree")) & (F.col("parent") == F.col("p_node")), "left_anti")
    return tops.select("tree", "digest", F.row_number().over(Window.partitionBy("tree", "digest").orderBy("node")).alias("k"), "ord", "size")


def _uncovered(nodes: DataFrame, tops: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """(nodes outside, nodes inside) the matched subtrees; those inside get ``top``, the ord of their subtree's root."""
    own = tops.select(F.col("tree").alias("t_tree"), F.col(f"{side}_ord").alias("t_ord"), (F.col(f"{side}_ord") + F.col("size") - 1).alias("t_end"))
    marked = nodes.join(_shuffled(own), (F.col("tree") == F.col("t_tree")) & (F.col("ord") == F.col("t_ord")), "left")
    last = F.max(F.when(F.col("t_ord").isNotNull(), F.struct("t_ord", "t_end"))).over(Window.partitionBy("tree").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("last", last).drop("t_tree", "t_ord", "t_end")
    inside = F.col("last").isNotNull() & (F.col("ord") <= F.col("last.t_end"))
    return marked.where(~inside).drop("last"), marked.where(inside).withColumn("top", F.col("last.t_ord")).drop("last")


def isomorphic_matches(a: DataFrame, b: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(``tree, a, b`` node pairs inside equal subtrees, ``tree, a_ord, b_ord, size`` of those subtrees' roots).

    From the top down: of the uncovered subtrees of at least ``least`` levels that both trees have, the outermost are
    paired in document order; what is left over of them opens its inner subtrees to the next round."""
    left, right, pairs, roots = a, b, [], []
    while True:
        x, y = _tops(left, right, least), _tops(right, left, least)
        met = x.select("tree", "digest", "k", F.col("ord").alias("a_ord"), "size").join(_shuffled(y.select("tree", "digest", "k", F.col("ord").alias("b_ord"))), ["tree", "digest", "k"])
        met = materialize(met.select("tree", "a_ord", "b_ord", "size"), "tree-tops")
        if met.isEmpty():
            break
        left, in_a = _uncovered(left, met, "a")
        right, in_b = _uncovered(right, met, "b")
        placed = in_a.join(_shuffled(met.withColumnRenamed("tree", "m_tree")), (F.col("tree") == F.col("m_tree")) & (F.col("top") == F.col("a_ord")))
        other = F.col("b_ord") + F.col("ord") - F.col("a_ord")
        inner = placed.select("tree", F.col("node").alias("a"), other.alias("other")).join(_as(in_b, "b_", "tree", "ord", "node"), (F.col("tree") == F.col("b_tree")) & (F.col("other") == F.col("b_ord")))
        pairs.append(materialize(inner.select("tree", "a", F.col("b_node").alias("b")), "tree-pairs"))
        roots.append(met)
        left, right = materialize(left, "tree-left"), materialize(right, "tree-right")
    if not pairs:
        empty = a.select("tree", F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        return empty, a.select("tree", F.col("ord").alias("a_ord"), F.col("ord").alias("b_ord"), "size").limit(0)
    return reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, roots)


def _without(nodes: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return nodes.join(_as(pairs, "m_", "tree", side), (F.col("tree") == F.col("m_tree")) & (F.col("node") == F.col(f"m_{side}")), "left_anti")


def mutual_best(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs ``tree, a, b`` of scored candidates (``tree, a, b, score``), best first.

    In every round the pairs that are the best of both their ends (equal scores: smaller a, then smaller b) are taken,
    and all other candidates of those ends go. Each round settles at least the best pair of every tree."""
    left, done = candidates, []
    while not left.isEmpty():
        rank = F.struct(F.col("score"), -F.col("a"), -F.col("b"))
        of_a = left.groupBy("tree", "a").agg(F.max(rank).alias("best")).select("tree", "a", (-F.col("best.col3")).alias("b"))
        of_b = left.groupBy("tree", "b").agg(F.max(rank).alias("best")).select("tree", "b", (-F.col("best.col2")).alias("a"))
        taken = materialize(of_a.join(_shuffled(of_b), ["tree", "a", "b"]), "tree-best")
        done.append(taken)
        for side in ("a", "b"):
            left = left.join(_as(taken, "t_", "tree", side), (F.col("tree") == F.col("t_tree")) & (F.col(side) == F.col(f"t_{side}")), "left_anti")
        left = materialize(left, "tree-candidates")
    return reduce(DataFrame.unionByName, done) if done else candidates.select("tree", "a", "b").limit(0)


def ancestor_candidates(a: DataFrame, b: DataFrame, pairs: DataFrame, roots: DataFrame, share: float) -> DataFrame:
    """``tree, a, b, score`` of unmatched inner nodes of one kind whose subtrees share matched descendants.

    ``score`` is the Dice coefficient of their descendants, at least ``share``. A matched subtree counts once with
    its size, at the ancestors of its roots. Nodes whose sizes alone rule the share out do not meet."""
    free = {"a": _without(a, pairs, "a"), "b": _without(b, pairs, "b")}
    above = {}
    for side, nodes in (("a", a), ("b", b)):
        own = roots.join(_as(nodes, "n_", "tree", "ord", "path"), (F.col("tree") == F.col("n_tree")) & (F.col(f"{side}_ord") == F.col("n_ord")))
        up = own.select("tree", "a_ord", "size", F.explode("n_path").alias("up"))
        known = free[side].select(F.col("tree").alias("f_tree"), F.col("node").alias(side), F.col("kind").alias("kind"), (F.col("size") - 1).alias(f"{side}_size"))
        above[side] = up.join(_shuffled(known), (F.col("tree") == F.col("f_tree")) & (F.col("up") == F.col(side))).select("tree", "a_ord", "size", side, "kind", f"{side}_size")
    met = above["a"].join(_shuffled(above["b"].drop("size")), ["tree", "a_ord", "kind"])
    most = F.least("a_size", "b_size") * 2.0 / (F.col("a_size") + F.col("b_size"))
    shared = met.where(most >= share).groupBy("tree", "a", "b", "a_size", "b_size").agg(F.sum("size").alias("common"))
    score = F.col("common") * 2.0 / (F.col("a_size") + F.col("b_size"))
    return shared.select("tree", "a", "b", score.alias("score")).where(F.col("score") >= share)


def _child_matches(a: DataFrame, b: DataFrame, pairs: DataFrame, newest: DataFrame) -> DataFrame:
    """Unmatched children of the newest pairs, met by kind in order."""
    sides = {}
    for side, nodes in (("a", a), ("b", b)):
        own = _without(nodes, pairs, side).join(_as(newest, "m_", "tree", "a", "b"), (F.col("tree") == F.col("m_tree")) & (F.col("parent") == F.col(f"m_{side}")))
        k = F.row_number().over(Window.partitionBy("tree", "m_a", "kind").orderBy("place"))
        sides[side] = own.select("tree", "m_a", "kind", k.alias("k"), F.col("node").alias(side))
    return sides["a"].join(_shuffled(sides["b"]), ["tree", "m_a", "kind", "k"]).select("tree", "a", "b")


def tree_matches(a: DataFrame, b: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """``tree, a, b``: one-to-one node pairs of two prepared forests.

    Equal subtrees first, then inner nodes by shared descendants, then roots of one kind and place, then the unmatched
    children of pairs that are not inside equal subtrees, by kind in order, down to the leaves."""
    pairs, roots = isomorphic_matches(a, b, least)
    above = mutual_best(materialize(ancestor_candidates(a, b, pairs, roots, share), "tree-candidates"))
    inner = pairs.unionByName(above)
    top = lambda nodes, side: _without(nodes.where("parent IS NULL"), inner, side).select("tree", "place", "kind", F.col("node").alias(side))
    newest = materialize(above.unionByName(top(a, "a").join(_shuffled(top(b, "b")), ["tree", "place", "kind"]).select("tree", "a", "b")), "tree-pairs")
    known = pairs.unionByName(newest)
    while not newest.isEmpty():
        newest = materialize(_child_matches(a, b, known, newest), "tree-pairs")
        known = known.unionByName(newest)
    return materialize(known, "tree-matches")


def _out_of_order(both: DataFrame) -> DataFrame:
    """``tree, a`` of matched children of matched parents that leave the longest run in common order.

    Only parents with an inversion are looked at."""
    order = Window.partitionBy("tree", "parent_a").orderBy("place_a")
    inverted = both.withColumn("inverted", F.coalesce(F.lag("place_b").over(order) > F.col("place_b"), F.lit(False)))
    worth = inverted.where("inverted").select("tree", "parent_a").distinct()
    rows = both.join(_shuffled(worth), ["tree", "parent_a"], "left_semi").select("tree", "parent_a", "place_a", "place_b", "a")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place_a")
        kept = pa.array(_kept_order(table.column("place_b").to_pylist()), pa.bool_())
        return table.filter(pa.compute.invert(kept)).select(["tree", "a"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("tree", "parent_a").applyInArrow(run, f"tree {kinds['tree']}, a {kinds['a']}")


def _whole_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of ``tree``, cut where a tree ends."""
    rest = []
    for batch in (x for x in batches if x.num_rows):
        trees = batch.column("tree")
        last = pc.index(trees, trees[-1]).as_py()
        if last or (rest and rest[0].column("tree")[-1] != trees[0]):
            yield pa.concat_batches([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.concat_batches(rest)


def _codes(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct entries, index of each entry among them, -1 for null)."""
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _compared(least: int, share: float) -> Callable:
    """Actions of ``tree, side, node, parent, place, kind, value`` rows that lie in order of the first three."""

    def actions(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bool, list[int]]]:
        """(action, row of the node, root, codes of the kinds of its ancestors)."""
        trees, parent = batch.column("tree"), batch.column("parent")
        kind, value = _codes(batch.column("kind"))[1], _codes(batch.column("value"))[1]
        columns = [batch.column("node").to_numpy(), parent.fill_null(0).to_numpy(), parent.is_null().to_numpy(zero_copy_only=False), batch.column("place").to_numpy(), kind, kind * (len(value) + 1) + value]
        side = batch.column("side").to_numpy()
        cuts = np.flatnonzero(pc.not_equal(trees.slice(1), trees.slice(0, len(trees) - 1)).to_numpy(zero_copy_only=False)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            middle, known = start + int(np.searchsorted(side[start:end], 1)), {}
            a, b = (Forest(*(c[i:j] for c in columns), known) for i, j in ((start, middle), (middle, end)))
            above, size = {}, 0
            for action, i, root in difference(a, b, least, share):
                own, first = (b, middle) if action in (INSERT, MOVE) else (a, start)
                key = first, own.parent[i]
                if key not in above:
                    if size > HANDED:
                        above, size = {}, 0
                    above[key] = [own.kind[k] for k in own.above(i)]
                    size += len(above[key])
                yield action, first + i, root, above[key]

    def handed(batch: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
        action, row, root, above = zip(*done)
        codes = np.fromiter((k for x in above for k in x), np.int64)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in above])))
        kinds = batch.column("kind").dictionary_encode().dictionary.take(pa.array(codes, mask=codes < 0))
        rows = batch.select(["tree", "node", "kind"]).take(pa.array(row))
        parents = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kinds)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(ACTIONS).take(pa.array(action)), rows.column(1), rows.column(2), parents, pa.array(root)], names=["tree", "action", "node", "kind", "parents", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_trees(batches):
            done, size = [], 0
            for x in actions(batch):
                done.append(x)
                size += 1 + len(x[3])
                if size > HANDED:
                    yield handed(batch, done)
                    done, size = [], 0
            if done:
                yield handed(batch, done)

    return run


def _difference_in_tasks(before: DataFrame, after: DataFrame, least: int, share: float, tasks: int) -> DataFrame:
    """:func:`tree_difference` with both versions of a tree in one task, which compares them one tree at a time.

    Long values are compared by digest, which is longer than any value that stays as it is."""
    sided = [df.select("tree", F.lit(i).alias("side"), *NODE[1:5], _kept_short(F.col("value"), 32).alias("value")) for i, df in enumerate((before, after))]
    rows = sided[0].unionByName(sided[1]).repartition(tasks, "tree").sortWithinPartitions("tree", "side", "node")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_compared(least, share), f"tree {kinds['tree']}, action string, node {kinds['node']}, kind string, parents array<string>, root boolean")


def tree_difference(before: DataFrame, after: DataFrame, least: int = 2, share: float = 0.5, held: int = 0) -> DataFrame:
    """``tree, action, node, kind, parents, root``: what turns the trees before into those after.

    ``delete`` and ``update`` name the node before, ``insert`` and ``move`` the node after. ``update``: matched, another value.
    ``move``: matched, but its parents are not, or it leaves the common order of their children. ``parents`` are the kinds of
    its ancestors, the nearest first; ``root`` is false for an insert or delete below another of its sort. Trees on one side only
    are inserted or deleted whole.

    A tree (a plain key) of at most ``held`` nodes, both versions together, is compared by one task after one exchange; all others,
    and those with a null in their keys, are compared by joins, with the same result. Both tables are then read twice at least."""
    if held:
        keys = [df.select("tree", (F.col("node").isNull() | F.col("place").isNull()).alias("odd")) for df in (before, after)]
        sizes = keys[0].unionByName(keys[1]).groupBy("tree").agg(F.count("*").alias("n"), F.max("odd").alias("odd"))
        large = F.col("tree").isNull() | F.col("odd") | (F.col("n") > held)
        nodes, apart = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(large)).first()
        tasks = max(3 * before.sparkSession.sparkContext.defaultParallelism, -(-nodes // TASK_NODES))
        if not apart:
            return _difference_in_tasks(before, after, least, share, tasks)
        marks = _shuffled(materialize(sizes.where(large).select(F.col("tree").alias("l_tree")), "tree-large"))
        part = lambda how: [df.join(marks, F.col("tree").eqNullSafe(F.col("l_tree")), how) for df in (before, after)]
        return _difference_in_tasks(*part("left_anti"), least, share, tasks).unionByName(tree_difference(*part("left_semi"), least, share))
    a, b = _prepared(before, after)
    pairs = tree_matches(a, b, least, share)
    gone, new = _without(a, pairs, "a"), _without(b, pairs, "b")
    under = lambda rows: rows.join(_as(rows, "u_", "tree", "node"), (F.col("tree") == F.col("u_tree")) & (F.col("parent") == F.col("u_node")), "left").withColumn("root", F.col("u_node").isNull())
    sides = pairs
    for side, nodes in (("a", a), ("b", b)):
        own = nodes.select(F.col("tree").alias("s_tree"), F.col("node").alias("s_node"), F.col("parent").alias(f"parent_{side}"), F.col("place").alias(f"place_{side}"), F.col("value").alias(f"value_{side}"))
        sides = sides.join(_shuffled(own), (F.col("tree") == F.col("s_tree")) & (F.col(side) == F.col("s_node"))).drop("s_tree", "s_node")
    up = _as(pairs, "p_", "tree", "a", "b")
    sides = materialize(sides.join(up, (F.col("tree") == F.col("p_tree")) & (F.col("parent_a") == F.col("p_a")), "left").withColumn("stays", F.col("p_b").eqNullSafe(F.col("parent_b")) & (F.col("parent_a").isNull() == F.col("parent_b").isNull())).drop("p_tree", "p_a", "p_b"), "tree-sides")
    updated = sides.where(~F.col("value_a").eqNullSafe(F.col("value_b"))).select("tree", F.col("a").alias("node"))
    crossed = _out_of_order(sides.where("stays").select("tree", F.coalesce("parent_a", F.lit(-1)).alias("parent_a"), "place_a", "place_b", "a"))
    moved = sides.where("NOT stays").select("tree", F.col("b").alias("node")).unionByName(sides.join(_shuffled(crossed), ["tree", "a"], "left_semi").select("tree", F.col("b").alias("node")))
    named = lambda rows, nodes: rows.join(_shuffled(nodes.select(F.col("tree").alias("n_tree"), F.col("node").alias("n_node"), "kind", "path")), (F.col("tree") == F.col("n_tree")) & (F.col("node") == F.col("n_node")))
    columns = lambda rows, action: rows.select("tree", F.lit(action).alias("action"), "node", "kind", "path", "root")
    old = columns(under(gone), "delete").unionByName(columns(named(updated, a).withColumn("root", F.lit(True)), "update"))
    late = columns(under(new), "insert").unionByName(columns(named(moved, b).withColumn("root", F.lit(True)), "move"))
    return _with_parents(old, a).unionByName(_with_parents(late, b))


def _with_parents(actions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path`` (ids) turned into ``parents`` (kinds): actions without parents pass by."""
    up = actions.select("tree", "action", "node", F.posexplode("path").alias("i", "up"))
    named = up.join(_shuffled(nodes.select(F.col("tree").alias("n_tree"), F.col("node").alias("n_node"), "kind")), (F.col("tree") == F.col("n_tree")) & (F.col("up") == F.col("n_node")))
    kinds = named.groupBy("tree", "action", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "kind"))), lambda x: x["kind"]).alias("parents"))
    joined = actions.join(_shuffled(kinds), ["tree", "action", "node"], "left")
    return joined.select("tree", "action", "node", "kind", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), "root")
