"""Mined renames against a plain greedy assignment, planted chains of renamed users, and the repairs that they make trivial."""

import random
from collections import Counter

import pytest

from patchloom.operators import encoders, history, renames

ELEMENTS, USES = "commit string, kind string, name string", "commit string, user string, slot int, name string"


def tables(spark, elements_before, elements_after, uses_before, uses_after):
    return [spark.createDataFrame(rows, kind) for rows, kind in ((elements_before, ELEMENTS), (elements_after, ELEMENTS), (uses_before, USES), (uses_after, USES))]


def plain(b, a, ub, ua):
    """Pairs by most votes, then names, users translated until nothing is added."""
    b, a = ({e for e in side if None not in e} for side in (b, a))

    def places(uses, now):
        at = {}
        for c, user, slot, name in uses:
            if name is not None and user is not None:
                at.setdefault((c, now.get((c, user), user), slot), set()).add(name)
        return {k: min(v) for k, v in at.items() if len(v) == 1}

    found = {}
    while True:
        now = {}
        for (c, _, old), (new, _) in found.items():
            now[c, old] = min(new, now.get((c, old), new))
        x, y, votes = places(ub, now), places(ua, {}), Counter()
        for (c, user, slot), old in x.items():
            new = y.get((c, user, slot))
            for kind in ("class", "method"):
                if (c, kind, old) in b - a and (c, kind, new) in a - b:
                    votes[c, kind, old, new] += 1
        taken = {(c, k, new) for (c, k, _), (new, _) in found.items()}
        more = False
        for (c, k, old, new), n in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
            if (c, k, old) not in found and (c, k, new) not in taken:
                found[c, k, old], more = (new, n), True
                taken.add((c, k, new))
        if not more:
            return {(c, k, old, new, n) for (c, k, old), (new, n) in found.items()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_greedy(spark, seed):
    r = random.Random(seed)
    names = [f"p.{x}{i}" for x in "ABC" for i in range(6)]
    pick = lambda: (r.choice("uv"), r.choice(["class", "method"]), r.choice(names))
    b, a = [pick() for _ in range(40)], [pick() for _ in range(40)] + [("u", "class", None)]
    use = lambda: (r.choice("uv"), r.choice([*names, None]), r.randrange(8), r.choice([*names, None]))
    ub, ua = [use() for _ in range(400)], [use() for _ in range(400)]
    found = renames.renamed_elements(*tables(spark, b, a, ub, ua)).collect()
    assert found and len(found) == len({tuple(x) for x in found}) and {tuple(x) for x in found} == plain(b, a, ub, ua)


def test_planted_renames_carry_their_places(spark):
    b = [("c", "class", "p.Old"), ("c", "class", "p.Inner"), ("c", "class", "p.Gone"), ("c", "method", "p.Old#run(int)"), ("c", "method", "p.Old#stay()"), ("c", "class", "p.Same")]
    a = [("c", "class", "p.New"), ("c", "class", "q.Core"), ("c", "class", "p.Fresh"), ("c", "method", "p.New#go(int)"), ("c", "method", "p.New#stay()"), ("c", "class", "p.Same")]
    ub = [("c", "T", 1, "p.Old"), ("c", "T", 2, "p.Same"), ("c", "p.Old", 1, "p.Old#run(int)"), ("c", "p.Old", 2, "p.Old#stay()"), ("c", "p.Old#run(int)", 1, "p.Inner")]
    ua = [("c", "T", 1, "p.New"), ("c", "T", 2, "p.Fresh"), ("c", "p.New", 1, "p.New#go(int)"), ("c", "p.New", 2, "p.New#stay()"), ("c", "p.New#go(int)", 1, "q.Core")]
    found = renames.mined_renames(*tables(spark, b, a, ub, ua))
    kept = {tuple(r) for r in found.collect()}
    assert kept == {("c", "RENAME_CLASS", "p.Old", "p.New", 1), ("c", "RENAME_METHOD", "p.Old#run(int)", "p.New#go(int)", 1), ("c", "MOVE_RENAME_CLASS", "p.Inner", "q.Core", 1)}
    assert history.renames_only(found, "refactoringType").count() == 3
    repairs = spark.createDataFrame([(1, "T", "b", "c"), (2, "X", "b", "c")], "ID int, name string, bCommit string, aCommit string")
    used = lambda c, name: spark.createDataFrame([(c, "T", name)], "commit string, test string, element string")
    trivial = encoders.trivial_types(repairs, found, used("b", "p.Old"), used("c", "p.New")).collect()
    assert [(r.ID, r.trivial) for r in trivial] == [(1, ["RENAME_CLASS"])]


def test_ties_and_empty_tables(spark):
    b, a = [("c", "class", "p.A"), ("c", "class", "p.B")], [("c", "class", "p.X"), ("c", "class", "p.Y")]
    ub = [("c", "T", i, n) for i, n in enumerate(["p.A", "p.A", "p.B", "p.B"])] * 2
    ua = [("c", "T", i, n) for i, n in enumerate(["p.X", "p.Y", "p.X", "p.Y"])]
    found = {(r.originalName, r.newName, r.votes) for r in renames.mined_renames(*tables(spark, b, a, ub, ua)).collect()}
    assert found == {("p.A", "p.X", 1), ("p.B", "p.Y", 1)}
    assert renames.mined_renames(*tables(spark, [], a, ub, [])).count() == 0


def test_each_table_is_exchanged_once(spark):
    """Declared names, places, and pairs by each of their ends; a plan names the declared names for both ends."""
    b, a = [("c", "class", "p.A"), ("c", "method", "p.A")], [("c", "class", "p.X"), ("c", "method", "p.A")]
    ub, ua = [("c", "T", i, "p.A") for i in range(3)] + [("c", None, 0, "p.A")], [("c", "T", i, "p.X") for i in range(3)] + [("c", None, 0, "p.X")]
    votes = renames.rename_votes(*tables(spark, b, a, ub, ua))
    assert votes._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 5
    assert [tuple(r) for r in votes.collect()] == [("c", "class", "p.A", "p.X", 3)]


def test_only_renamed_users_ask_again(spark):
    rows = [("c", "class", "p.A", "p.X", 3)]
    found = spark.createDataFrame(rows, "commit string, kind string, originalName string, newName string, votes long")
    uses = lambda user: spark.createDataFrame([("c", user, 1, "p.B"), ("d", "p.A", 1, "p.B")], USES)
    assert renames._any_renamed(uses("p.A"), found) and not renames._any_renamed(uses("p.C"), found)
    assert not renames._any_renamed(uses("p.A"), found.limit(0))
