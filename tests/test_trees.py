"""Trees as node tables against recursive versions on random trees."""

import random
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from patchloom.operators import metrics, trees

SCHEMA = "tree long, node long, parent long, place int, kind string, value string"


def grown(r, n, deep=0.5):
    """A random forest as rows (node, parent, place, kind, value), ids in document order."""
    shape, last = defaultdict(list), [None]
    for i in range(n):
        parent = None if i == 0 else last[-1] if r.random() < deep else r.randrange(i)
        shape[parent].append(i)
        last.append(i)
    return relabel(shape, [(r.choice("abc"), r.choice(["x", "y", None])) for _ in range(n)])


def relabel(shape, labels):
    rows, count = [], [0]

    def walk(old, parent, place):
        own = count[0]
        count[0] += 1
        rows.append((own, parent, place, *labels[old]))
        for k, child in enumerate(shape[old]):
            walk(child, own, k)

    for k, top in enumerate(shape[None]):
        walk(top, None, k)
    return rows


def changed(r, rows):
    """The rows after some deletions, insertions, value changes and moves."""
    shape, labels = defaultdict(list), {}
    for node, parent, _, kind, value in rows:
        shape[parent].append(node)
        labels[node] = (kind, value)
    nodes = [x[0] for x in rows]
    for _ in range(r.randint(1, 4)):
        x = r.choice(nodes)
        where = next((p for p in list(shape) if x in shape[p]), "gone")
        if where == "gone":
            continue
        what = r.choice(["delete", "insert", "update", "move"])
        if what == "delete" and where is not None:
            shape[where].remove(x)
        elif what == "insert":
            new = max(labels) + 1
            labels[new] = (r.choice("abc"), "new")
            shape[x].insert(r.randint(0, len(shape[x])), new)
        elif what == "update":
            labels[x] = (labels[x][0], "changed")
        elif where is not None:
            inside, todo = set(), [x]
            while todo:
                inside.add(todo[0])
                todo = todo[1:] + shape[todo[0]]
            goal = r.choice([n for n in nodes if n not in inside])
            shape[where].remove(x)
            shape[goal].insert(r.randint(0, len(shape[goal])), x)
    return relabel(shape, labels)


class Tree:
    def __init__(self, rows):
        self.rows = {x[0]: x for x in rows}
        self.kids = defaultdict(list)
        for x in sorted(rows, key=lambda x: x[2]):
            self.kids[x[1]].append(x[0])
        self.order = sorted(self.rows)
        self.parent = {x[0]: x[1] for x in rows}
        self.kind = {x[0]: x[3] for x in rows}
        self.value = {x[0]: x[4] for x in rows}

    def text(self, n, label):
        return "(" + " ".join([label(n), *(self.text(k, label) for k in self.kids[n])]) + ")"

    def under(self, n):
        return [n, *(x for k in self.kids[n] for x in self.under(k))]

    def height(self, n):
        return 1 + max((self.height(k) for k in self.kids[n]), default=0)

    def path(self, n):
        return [] if self.parent[n] is None else [self.parent[n], *self.path(self.parent[n])]


def plain_difference(before, after, least=2, share=0.5):
    a, b = Tree(before), Tree(after)
    full = {id(t): {n: t.text(n, lambda n, t=t: f"{t.kind[n]}={t.value[n]}") for n in t.order} for t in (a, b)}
    left, right, pairs, roots = set(a.order), set(b.order), {}, []

    def tops(t, own, other, others):
        texts = {full[id(other)][n] for n in others}
        shared = {n for n in own if t.height(n) >= least and full[id(t)][n] in texts}
        out = defaultdict(list)
        for n in sorted(shared):
            if t.parent[n] not in shared:
                out[full[id(t)][n]].append(n)
        return out

    while True:
        x, y = tops(a, left, b, right), tops(b, right, a, left)
        met = [(p, q) for key in x for p, q in zip(x[key], y.get(key, []))]
        if not met:
            break
        for p, q in met:
            roots.append((p, q))
            for i, j in zip(sorted(a.under(p)), sorted(b.under(q))):
                pairs[i] = j
                left.discard(i)
                right.discard(j)
    common = Counter()
    for p, q in roots:
        for i in a.path(p):
            for j in b.path(q):
                if i not in pairs and j not in pairs.values() and a.kind[i] == b.kind[j]:
                    common[i, j] += len(a.under(p))
    dice = {(i, j): 2.0 * c / (len(a.under(i)) + len(b.under(j)) - 2) for (i, j), c in common.items()}
    scored = [(s, i, j) for (i, j), s in dice.items() if s >= share]
    newest = {}
    while scored:
        best = sorted(scored, key=lambda x: (-x[0], x[1], x[2]))
        one, two = {}, {}
        for s, i, j in best:
            one.setdefault(i, j)
        for s, i, j in best:
            two.setdefault(j, i)
        taken = {(i, j) for i, j in one.items() if two[j] == i}
        newest.update(taken)
        scored = [x for x in scored if x[1] not in {i for i, _ in taken} and x[2] not in {j for _, j in taken}]
    used = {**pairs, **newest}
    free = lambda t, side, places: {(t.rows[n][2], t.kind[n]): n for n in t.kids[None] if n not in places}
    x, y = free(a, 0, set(used)), free(b, 1, set(used.values()))
    newest.update({x[k]: y[k] for k in x if k in y})
    pairs.update(newest)
    while newest:
        found = {}
        for i, j in newest.items():
            by = defaultdict(lambda: ([], []))
            for n in a.kids[i]:
                if n not in pairs:
                    by[a.kind[n]][0].append(n)
            for n in b.kids[j]:
                if n not in pairs.values():
                    by[b.kind[n]][1].append(n)
            for p, q in by.values():
                found.update(zip(p, q))
        pairs.update(found)
        newest = found
    out = []
    back = {j: i for i, j in pairs.items()}
    for n in a.order:
        if n not in pairs:
            out.append(("delete", n, a, n, a.parent[n] is None or a.parent[n] in pairs))
    for n in b.order:
        if n not in back:
            out.append(("insert", n, b, n, b.parent[n] is None or b.parent[n] in back))
    groups = defaultdict(list)
    for i, j in pairs.items():
        if a.value[i] != b.value[j]:
            out.append(("update", i, a, i, True))
        p, q = a.parent[i], b.parent[j]
        if (p is None) != (q is None) or (p is not None and pairs.get(p) != q):
            out.append(("move", j, b, j, True))
        else:
            groups[p].append((a.rows[i][2], b.rows[j][2], j))
    for rows in groups.values():
        ranks = [x[1] for x in sorted(rows)]
        for keep, (_, _, j) in zip(longest(ranks), sorted(rows)):
            if not keep:
                out.append(("move", j, b, j, True))
    return Counter((what, n, t.kind[n], tuple(t.kind[x] for x in t.path(n)), root) for what, n, t, _, root in out), pairs


def longest(ranks):
    return trees._kept_order(ranks)


def test_nesting_of_tokens(spark):
    r, rows, want = random.Random(6), [], {}
    for k in range(8):
        whole = grown(r, 20, 0.4)
        t, tokens, ids = Tree(whole), [], {}

        def walk(n):
            ids[n] = len(tokens)
            tokens.append([1 if t.kids[n] else 0, t.kind[n], t.value[n]])
            for c in t.kids[n]:
                walk(c)
            if t.kids[n]:
                tokens.append([-1, None, None])

        for n in t.kids[None]:
            walk(n)
        rows += [(k, i, *x) for i, x in enumerate(tokens)]
        want[k] = {(ids[n], ids.get(t.parent[n]), t.rows[n][2], t.kind[n], t.value[n]) for n in t.order}
    got = defaultdict(set)
    for x in trees.nested(spark.createDataFrame(rows, "tree long, node long, step int, kind string, value string")).collect():
        got[x.tree].add((x.node, x.parent, x.place, x.kind, x.value))
    assert got == want


def table(spark, forests):
    return spark.createDataFrame([(k, *row) for k, rows in forests.items() for row in rows], SCHEMA).repartition(3)


def test_kept_order_is_a_longest_increasing_run():
    r = random.Random(1)
    for _ in range(200):
        ranks = r.sample(range(9), r.randint(0, 9))
        kept = [x for x, k in zip(ranks, trees._kept_order(ranks)) if k]
        tails = []
        for x in ranks:
            tails[bisect_left(tails, x) : bisect_left(tails, x) + 1] = [x]
        assert kept == sorted(kept) and len(kept) == len(tails)


def test_paths_texts_sizes_and_heights(spark):
    r = random.Random(2)
    forests = {k: grown(r, r.randint(1, 30), 0.1 * k) for k in range(6)} | {9: grown(r, 24, 1.0), 10: [(0, None, 0, "a", None)] + [(i, 0, i - 1, "b", "v") for i in range(1, 30)]}
    nodes = table(spark, forests)
    got = {(x.tree, x.node): x for x in trees.folded(trees.with_paths(nodes), longest=10**6).collect()}
    cut = {(x.tree, x.node): x for x in trees.folded(trees.with_paths(nodes), longest=30, fan=7).collect()}
    assert len(got) == len(cut) == sum(map(len, forests.values()))
    whole, short = defaultdict(set), defaultdict(set)
    for k, rows in forests.items():
        t = Tree(rows)
        for n in t.order:
            x = got[k, n]
            assert (x.path, x.depth, x.size, x.height) == (t.path(n), len(t.path(n)), len(t.under(n)), t.height(n))
            assert x.text == t.text(n, t.kind.get)
            whole[x.text].add((k, n))
            short[cut[k, n].text].add((k, n))
            assert len(cut[k, n].text) <= 33
    assert sorted(map(sorted, whole.values())) == sorted(map(sorted, short.values()))
    assert trees.folded(trees.with_paths(nodes.limit(0))).count() == 0


def test_subtrees_feed_the_match(spark):
    r = random.Random(3)
    ones, twos = {k: grown(r, 20, 0.2) for k in range(5)}, {k: grown(r, 20, 0.2) for k in range(5)}
    found = metrics.tree_match(trees.subtrees(table(spark, ones)), trees.subtrees(table(spark, twos)), ["tree"], "text").collect()

    def inner(rows):
        t = Tree(rows)
        return [t.text(n, t.kind.get) for n in t.order if t.kids[n] or t.parent[n] is None]

    want = {k: (sum(x in inner(twos[k]) for x in inner(ones[k])), len(inner(ones[k]))) for k in ones}
    assert {x.tree: (x.matched, x.total) for x in found} == want


def test_difference_of_random_trees(spark):
    r = random.Random(4)
    before = {k: grown(r, r.randint(3, 30), 0.15) for k in range(60)}
    after = {k: changed(r, before[k]) if k % 10 else grown(r, 12) for k in range(59)} | {80: grown(r, 4)}
    got = defaultdict(Counter)
    for x in trees.tree_difference(table(spark, before), table(spark, after)).collect():
        got[x.tree][x.action, x.node, x.kind, tuple(x.parents), x.root] += 1
    kinds = Counter()
    for k in sorted({*before, *after}):
        want, pairs = plain_difference(before.get(k, []), after.get(k, []))
        assert len(set(pairs.values())) == len(pairs)
        assert got[k] == want, k
        kinds.update(x[0] for x in want.elements())
    assert all(kinds[x] > 5 for x in ("insert", "delete", "update", "move"))


def test_equal_and_lonely_trees(spark):
    rows = {k: grown(random.Random(k), 12, 0.1) for k in range(3)}
    got = trees.tree_difference(table(spark, {0: rows[0], 1: rows[1]}), table(spark, rows)).collect()
    assert {(x.tree, x.action) for x in got} == {(2, "insert")} and len(got) == 12 and sum(x.root for x in got) == 1


def test_one_changed_leaf_and_one_moved_subtree(spark):
    old = [(0, None, 0, "m", None), (1, 0, 0, "if", None), (2, 1, 0, "name", "a"), (3, 1, 1, "name", "b"), (4, 0, 1, "call", None), (5, 4, 0, "name", "f"), (6, 4, 1, "lit", "1")]
    new = [(0, None, 0, "m", None), (1, 0, 0, "call", None), (2, 1, 0, "name", "f"), (3, 1, 1, "lit", "2"), (4, 0, 1, "if", None), (5, 4, 0, "name", "a"), (6, 4, 1, "name", "b")]
    rows = trees.tree_difference(table(spark, {1: old}), table(spark, {1: new})).collect()
    assert Counter((x.action, x.kind) for x in rows) == Counter([("move", "if"), ("update", "lit")]) or Counter((x.action, x.kind) for x in rows) == Counter([("move", "call"), ("update", "lit")])
    assert next(x.parents for x in rows if x.action == "update") == ["call", "m"]


def test_no_tree_table_goes_through_the_driver(spark, monkeypatch):
    """Scratch tables compress well, so their files may look small enough to broadcast; none of their joins does."""
    from pyspark.sql import DataFrameWriter
    from pyspark.sql import functions as F

    rows = [(t, n, None if n == 0 else 0, n, "k" if n else "top", f"v{(n + t) % 3}") for t in range(2) for n in range(6)]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, place int, kind string, value string")
    plans, write = [], DataFrameWriter.parquet

    def kept(self, path, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    done = trees.tree_difference(frame.where("tree = 0"), frame.where("tree = 1").withColumn("tree", F.lit(0).cast("long")))
    plans.append(done._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoop" in p]


def test_depth_without_paths_or_values(spark):
    rows = [(1, i, i - 1 if i else None, 0, "k", "long value") for i in range(37)] + [(2, 0, None, 0, "a", None), (2, 1, None, 1, "b", None), (2, 2, 1, 0, "c", None), (2, 3, 99, 0, "lost", None)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, place int, kind string, value string")
    slim = trees.with_depth(nodes)
    assert slim.columns == ["tree", "node", "parent", "place", "kind", "depth"]
    both = slim.join(trees.with_paths(nodes).select("tree", "node", F.col("depth").alias("d")), ["tree", "node"])
    assert both.count() == len(rows) and both.where("depth <> d").count() == 0
    assert trees.with_depth(nodes.limit(0)).count() == 0


def test_rows_are_spread_over_tasks(spark):
    from patchloom.plans.registry import spread

    assert spread(spark.range(1), "id").rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def odd(forests):
    """Rows with nodes below a parent that is none, and with null kinds."""
    r, out = random.Random(12), {}
    for k, rows in forests.items():
        lost = r.randrange(1, len(rows)) if k % 4 == 1 and len(rows) > 1 else None
        out[k] = [(n, 999 if n == lost else p, place, None if k % 5 == 2 and n % 3 == 1 else kind, value) for n, p, place, kind, value in rows]
    return out


@pytest.mark.parametrize("held", [30, 10_000])
def test_difference_in_tasks_is_that_by_joins(spark, held):
    """Trees of at most ``held`` nodes are compared one at a time, larger ones by joins; long values, several roots, odd rows."""
    r = random.Random(7)
    before = {k: grown(r, r.randint(3, 40), 0.2) for k in range(40)}
    after = {k: changed(r, before[k]) if k % 7 else grown(r, 14) for k in range(38)} | {50: grown(r, 5)}
    wide = lambda f: {k: [(*x[:4], x[4] if x[4] != "x" else "long " * 20) for x in rows] for k, rows in f.items()}
    got = Counter((x.tree, x.action, x.node, x.kind, tuple(x.parents), x.root) for x in trees.tree_difference(table(spark, wide(before)), table(spark, wide(after)), held=held).collect())
    want = Counter()
    for k in sorted({*before, *after}):
        for x, n in plain_difference(wide(before).get(k, []), wide(after).get(k, []))[0].items():
            want[(k, *x)] += n
    assert got == want
    strange = table(spark, odd(before)), table(spark, odd(after) | {None: [(0, None, 0, "a", None), (1, 0, 0, "b", "v")]})
    both = [Counter((x.tree, x.action, x.node, x.kind, tuple(x.parents), x.root) for x in trees.tree_difference(*strange, held=h).collect()) for h in (0, held)]
    assert both[0] == both[1] and any(x[0] is None for x in both[0])
    assert trees.tree_difference(table(spark, before).limit(0), table(spark, after).limit(0), held=held).count() == 0


def test_trees_are_cut_whole_out_of_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 4, 5, 5]
    for size in range(1, 13):
        batches = [pa.record_batch({"tree": keys[i : i + size], "n": list(range(i, min(i + size, 12)))}) for i in range(0, 12, size)]
        cut = [x.to_pydict() for x in trees._whole_trees([*batches, batches[0].slice(0, 0)])]
        assert [n for x in cut for n in x["n"]] == list(range(12))
        assert all(set(x["tree"]).isdisjoint(y["tree"]) for i, x in enumerate(cut) for y in cut[:i])


def test_small_trees_take_no_rounds(spark, monkeypatch):
    """The query's pages are compared where they are: no table a round is written, only the nodes."""
    from pyspark.sql import DataFrameWriter

    from patchloom.plans import catalogue

    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **options: (written.append(path), write(self, path, **options))[1])
    done = catalogue.QUERIES["tree_difference"](spark, "/root/testdata/sf0.001")
    assert done.count() > 0 and len(written) == 1


def test_long_chains_are_handed_on_in_parts(spark, monkeypatch):
    """Parents of a chain are as many as the square of its length; what a task hands on together stays bounded."""
    chain = [(i, i - 1 if i else None, 0, f"k{i % 3}", str(i)) for i in range(300)]
    other = [(i, i - 1 if i else None, 0, f"k{i % 3}", str(i if i % 2 else -i)) for i in range(300)]
    monkeypatch.setattr(trees, "HANDED", 500)
    run = trees._compared(2, 0.5)
    import pyarrow as pa

    rows = [(7, side, *x) for side, t in enumerate((chain, other)) for x in t]
    batch = pa.RecordBatch.from_pylist([dict(zip(["tree", "side", "node", "parent", "place", "kind", "value"], x)) for x in rows])
    out = list(run([batch]))
    assert len(out) > 10 and all(len(x.column("parents").flatten()) <= 900 for x in out)
    want = plain_difference(chain, other)[0]
    assert Counter((x["action"], x["node"], x["kind"], tuple(x["parents"]), x["root"]) for b in out for x in b.to_pylist()) == want
