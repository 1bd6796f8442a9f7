"""Nearest names and least overlaps against all pairs, with the work counted."""

import math
import random
from collections import defaultdict

from patchloom.functions.similarity import jaro_winkler_score
from patchloom.operators import joins


def rounded(x):
    return math.floor(x * 1e6 + 0.5) / 1e6


def names(r, n):
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 8))) for _ in range(40)]
    out = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return [x if r.random() < 0.7 else x[: r.randint(0, len(x))] for x in out]


def test_nearest_names_are_those_of_all_pairs(spark):
    r = random.Random(1)
    a = [(i, r.choice("xy"), t) for i, t in enumerate(names(r, 150))] + [(900, None, "abc"), (901, "x", None), (902, "x", ""), (903, "z", "abc")]
    b = [(i, r.choice("xy"), t) for i, t in enumerate(names(random.Random(2), 150))] + [(901, "x", None), (902, "x", "")]
    b += [(i + 1000, k, t) for i, k, t in a[:40]]
    found, _ = joins.nearest_names(spark.createDataFrame(a, "id long, g string, name string"), spark.createDataFrame([(k, t, i) for i, k, t in b], "g string, other_name string, other long"), ["g"], "name", "other_name", "other")
    got = {x.id: (x.similarity, x.other) for x in found.collect()}
    want = {}
    for i, g, t in a:
        scored = [(-rounded(jaro_winkler_score(t, u)), j) for j, h, u in b if h == g and g is not None and t is not None and u is not None]
        if scored and -min(scored)[0] > 0.65:
            want[i] = (-min(scored)[0], min(scored)[1])
    assert got == want and len(want) > 100


def test_own_rows_do_not_match(spark):
    r = random.Random(3)
    rows = [(i, "g", t) for i, t in enumerate(names(r, 120))]
    rows += [(i + 500, k, t) for i, k, t in rows[:30]]
    a = spark.createDataFrame(rows, "id long, g string, name string")
    b = a.selectExpr("id AS other", "g", "name AS other_name")
    got = {x.id: (x.similarity, x.other) for x in joins.nearest_names(a, b, ["g"], "name", "other_name", "other", own="id")[0].collect()}
    want = {}
    for i, _, t in rows:
        best = min((-rounded(jaro_winkler_score(t, u)), j) for j, _, u in rows if j != i)
        if -best[0] > 0.65:
            want[i] = (-best[0], best[1])
    assert got == want
    assert joins.nearest_names(a.limit(0), b, ["g"], "name", "other_name", "other")[0].count() == 0


def test_few_pairs_are_compared(spark):
    """Below a tenth of the square of a group, and a smaller part of larger groups."""
    shares = []
    for n in (200, 400, 800):
        r = random.Random(n)
        plain = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 14))) for _ in range(n)]
        near = [x[:-1] + r.choice("xyz") for x in plain]
        a = spark.createDataFrame([(i, "g", x) for i, x in enumerate(plain)], "id long, g string, name string")
        b = spark.createDataFrame([(i, "g", x) for i, x in enumerate(near)], "other long, g string, other_name string")
        _, compared = joins.nearest_names(a, b, ["g"], "name", "other_name", "other")
        shares.append(sum(x.count() for x in compared) / (n * n))
    assert max(shares) < 0.1 and shares[2] <= shares[0]


def test_overlapping(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    docs = {i: [r.choice(vocab[: r.choice([5, 60])]) for _ in range(r.randint(0, 40))] for i in range(60)}
    items = {i: [r.choice(vocab) for _ in range(r.randint(1, 8))] for i in range(30)}
    rows = lambda d, name: spark.createDataFrame([(k, w) for k, ws in d.items() for w in ws], f"{name} long, w string")
    for share in (0.5, 0.8, 1.0):
        got = {(x.d, x.i) for x in joins.overlapping(rows(docs, "d"), rows(items, "i"), "d", "i", "w", share).collect()}
        want = defaultdict(int)
        for d, ws in docs.items():
            for i, us in items.items():
                if len(set(ws) & set(us)) >= math.ceil(len(set(us)) * share):
                    want[d, i] = 1
        assert got == set(want) and want


def test_overlaps_count_every_document_and_item_that_share_a_word(spark, tmp_path):
    from patchloom.plans import textual

    spark.createDataFrame([(1, "a a b"), (2, "z"), (3, ""), (4, None), (5, "a\tb  a c d e")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "a a a x y w v"), (8, "q"), (9, "e b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(textual.multiset_overlap(spark, str(tmp_path))) == [(1, 7, 2), (1, 9, 1), (5, 7, 2), (5, 9, 2)]
    assert rows(textual.set_overlap(spark, str(tmp_path))) == [(1, 7, 3), (1, 9, 1), (5, 7, 3), (5, 9, 2)]
