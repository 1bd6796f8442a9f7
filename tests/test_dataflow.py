"""Reaching definitions against a worklist version on random control flow."""

import random
from collections import Counter, defaultdict

from patchloom.operators import dataflow, metrics

SCHEMA = "unit long, block int, stmt int, pos long, role string, name string"


def programme(r):
    """Blocks of statements (definitions, uses) and edges, with branches, loops and blocks that nothing reaches."""
    blocks = {b: [([r.choice("xyz") for _ in range(r.randint(0, 2))], [r.choice("xyz") for _ in range(r.randint(0, 2))]) for _ in range(r.randint(0, 3))] for b in range(r.randint(1, 7))}
    edges = {(r.choice(list(blocks)), r.choice(list(blocks))) for _ in range(r.randint(0, 10))}
    return blocks, edges


def rows(unit, blocks):
    out, pos = [], 0
    for b, statements in blocks.items():
        for s, (made, used) in enumerate(statements):
            for role, names in (("def", made), ("use", used)):
                for name in names:
                    out.append((unit, b, s, pos, role, name))
                    pos += 1
    return out


def worklist(own, edges):
    """(use, name, definition or None) by the textbook fixpoint over sets of definitions."""
    by = defaultdict(list)
    for row in own:
        by[row[1]].append(row)
    blocks = {b for e in edges for b in e} | set(by)
    order = lambda x: (x[2], x[4] == "def", x[3])

    def run(block, state):
        for row in sorted(by[block], key=order):
            if row[4] == "use":
                yield row, {d for d in state if d[0] == row[5]}
            else:
                state = {d for d in state if d[0] != row[5]} | {(row[5], row[3])}
        run.out = state

    entry = {b: set() for b in blocks}
    todo = list(blocks)
    while todo:
        b = todo.pop()
        list(run(b, entry[b]))
        for s, t in edges:
            if s == b and not run.out <= entry[t]:
                entry[t] |= run.out
                todo.append(t)
    found = Counter()
    for b in blocks:
        for row, reach in run(b, entry[b]):
            for d in reach or {(None, None)}:
                found[row[3], row[5], d[1]] += 1
    return found


def test_reaching_definitions(spark):
    r = random.Random(8)
    units = {k: programme(r) for k in range(60)}
    occurrences = spark.createDataFrame([x for k, (b, _) in units.items() for x in rows(k, b)], SCHEMA).repartition(3)
    flow = spark.createDataFrame([(k, s, t) for k, (_, e) in units.items() for s, t in e], "unit long, src int, dst int")
    got = defaultdict(Counter)
    for x in dataflow.reaching(occurrences, flow).collect():
        got[x.unit][x.pos, x.name, x.def_pos] += 1
    loops = 0
    for k, (blocks, edges) in units.items():
        want = worklist(rows(k, blocks), edges)
        assert got[k] == want, k
        loops += any(d is not None and d > p for p, _, d in want)
    assert loops > 5
    assert dataflow.reaching(occurrences.limit(0), flow).count() == 0


def test_edges_of_a_loop(spark):
    """i = 0; while (i < n) { s = s + i; i = i + 1 } return s"""
    own = [(1, 0, 0, 0, "def", "i"), (1, 1, 0, 1, "use", "i"), (1, 1, 0, 2, "use", "n"), (1, 2, 0, 4, "use", "s"), (1, 2, 0, 5, "use", "i"), (1, 2, 0, 3, "def", "s"), (1, 2, 1, 7, "use", "i"), (1, 2, 1, 6, "def", "i"), (1, 3, 0, 8, "use", "s")]
    flow = [(1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 1, 3)]
    edges = dataflow.flow_edges(spark.createDataFrame(own, SCHEMA), spark.createDataFrame(flow, "unit long, src int, dst int"))
    got = {(x.pos, x.kind, x.source_pos) for x in edges.collect()}
    assert got == {(0, "comesFrom", None), (1, "comesFrom", 0), (1, "comesFrom", 6), (2, "comesFrom", None), (4, "comesFrom", 3), (5, "comesFrom", 0), (5, "comesFrom", 6), (3, "computedFrom", 4), (3, "computedFrom", 5), (7, "comesFrom", 0), (7, "comesFrom", 6), (6, "computedFrom", 7), (8, "comesFrom", 3)}
    normal = metrics.normal_flow(metrics.merged_flow(edges, ["unit"]), ["unit"])
    assert Counter(x.edge for x in normal.collect())["var_1 computedFrom var_1 var_0"] == 1


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_dealt_units_are_not_exchanged_again(spark):
    r = random.Random(3)
    units = {k: programme(r) for k in range(9)}
    occurrences = spark.createDataFrame([x for k, (b, _) in units.items() for x in rows(k, b)], SCHEMA).repartition(5, "unit")
    flow = spark.createDataFrame([(k, s, t) for k, (_, e) in units.items() for s, t in e], "unit long, src int, dst int").repartition(5, "unit")
    assert exchanges(dataflow.reaching(occurrences, flow)) == 2


def test_null_keys_meet_nothing(spark):
    own = [(1, 0, 0, 0, "def", "i"), (1, None, 1, 1, "use", "i"), (1, 1, 2, 2, "use", "i"), (None, 0, 0, 0, "def", "i"), (None, 1, 0, 3, "use", "i"), (1, None, 3, 4, "def", "j"), (1, 1, 4, 5, "use", "j")]
    flow = spark.createDataFrame([(1, 0, 1), (1, 0, None), (1, None, 1), (None, 0, 1)], "unit long, src int, dst int")
    got = {(x.unit, x.pos, x.def_pos) for x in dataflow.reaching(spark.createDataFrame(own, SCHEMA), flow).collect()}
    assert got == {(1, 1, None), (1, 2, 0), (None, 3, None), (1, 5, None)}


def test_edges_of_dealt_units_stay_where_they_are(spark):
    """An edge at either end of a dependence is kept, a lone one is not; the rows of a task are bounded by their number."""
    from patchloom.plans.registry import spread

    rows = [(1, 0, "a", "comesFrom", None, None), (1, 1, "b", "computedFrom", 0, "a"), (1, 2, "c", "comesFrom", None, None), (1, 3, "b", "comesFrom", 9, "z"), (2, 0, "d", "comesFrom", None, None)]
    edges = spark.createDataFrame(rows, "unit long, pos long, name string, kind string, source_pos long, source_name string").repartition(5, "unit")
    flow = metrics.merged_flow(edges, ["unit"])
    assert {(x.unit, x.pos, x.name, x.kind, tuple(map(tuple, x.sources))) for x in flow.collect()} == {(1, 0, "a", "comesFrom", ()), (1, 1, "b", "computedFrom", ((0, "a"),)), (1, 3, "b", "comesFrom", ((9, "z"),))}
    assert exchanges(metrics.normal_flow(flow, ["unit"])) == 1
    occurrences = spark.createDataFrame([(1, 0, 0, 0, "def", "i")], SCHEMA).repartition(5, "unit")
    steps = spark.createDataFrame([(1, 0, 1)], "unit long, src int, dst int").repartition(5, "unit")
    assert exchanges(dataflow.flow_edges(occurrences, steps)) <= 3  # uses, definitions, edges: each table as it was dealt
    assert spread(spark.range(100), "id", rows=2).rdd.getNumPartitions() == 50
