"""Sentence BLEU under each smoothing method against a plain version."""

import math
import random
from collections import Counter

import pytest

from patchloom.operators import metrics


def grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def precision(hyp, ref, n):
    h, r = Counter(grams(hyp, n)), Counter(grams(ref, n))
    return sum(min(c, r[g]) for g, c in h.items()), max(1, sum(h.values()))


def plain(hyp, ref, method):
    """None where a precision of 0 is left."""
    parts = [precision(hyp, ref, n) for n in range(1, 6)]
    if parts[0][0] == 0:
        return 0.0
    p, extra, size = [a / b for a, b in parts[:4]], parts[4][0] / parts[4][1], len(hyp)
    if method == 0:
        p = [x or 2.2250738585072014e-308 for x in p]
    if method == 1:
        p = [x or 0.1 / b for x, (_, b) in zip(p, parts)]
    if method == 2:
        p = [(a + 1) / (b + 1) for a, b in parts[:4]]
    if method == 3:
        zeros = 0
        for i, (a, b) in enumerate(parts[:4]):
            zeros += a == 0
            p[i] = p[i] or 1 / (2**zeros * b)
    if method in (4, 7) and size > 1:
        p = [x or (i + 5 / math.log(size)) / parts[i][1] for i, x in enumerate(p)]
    if method in (5, 7):
        after, last = [*p[1:], extra], p[0] + 1
        for i in range(4):
            p[i] = last = (last + p[i] + after[i]) / 3
    if method == 6:
        for i in (2, 3):
            expected = p[i - 1] ** 2 / p[i - 2] if p[i - 2] else 0
            p[i] = (parts[i][0] + 5 * expected) / (len(grams(hyp, i + 1)) + 5)
    if min(p) <= 0:
        return None
    short = 1.0 if size > len(ref) else math.exp(1 - len(ref) / size)
    return short * math.exp(sum(map(math.log, p)) / 4)


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(3)
    rows = [([r.choice("abc") for _ in range(r.randrange(1, 12))], [r.choice("abcd") for _ in range(r.randrange(1, 12))]) for _ in range(60)]
    return [*rows, (["a"], ["a"]), (list("abcdef"), list("abcdef")), (["a", "b"], ["b", "a"]), ([], ["a"]), (["a"], [])]


@pytest.mark.parametrize("method", range(8))
def test_methods(spark, pairs, method):
    table = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "i int, h array<string>, r array<string>")
    found = {x.i: x.bleu for x in metrics.sentence_bleu(table, ["i"], "h", "r", method=method).collect()}
    want = {i: plain(h, r, method) for i, (h, r) in enumerate(pairs)}
    assert found.keys() == want.keys()
    for i, score in want.items():
        assert found[i] == (score if score is None else pytest.approx(score, rel=1e-9)), pairs[i]


def test_runs_are_counted_inside_the_row(spark, pairs):
    table = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "i int, h array<string>, r array<string>")
    for counted in (metrics.sentence_bleu(table, ["i"], "h", "r"), metrics.weighted_recall(table, ["i"], "h", "r", ("a",))):
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_weighted_recall_and_corpus_scores(spark, pairs):
    table = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "i int, h array<string>, r array<string>")
    found = {(x.i, x.n): (x.num, x.den) for x in metrics.weighted_recall(table, ["i"], "h", "r", ("a",)).collect()}
    want, has, asked = {}, 0, 0
    for i, (h, r) in enumerate(pairs):
        has, asked = has + sum(w in h for w in r), asked + len(r)
        for n in range(1, 5):
            own, other = Counter(grams(h, n)), Counter(grams(r, n))
            weight = lambda g, n=n: 1.0 if n > 1 or g == ("a",) else 0.2
            if other:
                want[i, n] = sum(min(c, own[g]) * weight(g) for g, c in other.items()), max(1.0, sum(c * weight(g) for g, c in other.items()))
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    scores = metrics.corpus_scores(table, ["i"], "h", "r", ("a",)).first()
    assert (scores.found, scores.total) == (has, asked)
    assert scores.bleu == metrics.corpus_bleu(table, ["i"], "h", "r").first().bleu


def test_nulls_among_words_and_references(spark):
    rows = [(1, ["a", None, "b"], [["a", "b"], None]), (2, None, [["a"]]), (3, ["a", "a"], [["a"], ["a", "a", "c"]])]
    table = spark.createDataFrame(rows, "i int, h array<string>, r array<array<string>>")
    from pyspark.sql import functions as F

    found = {x.i: (x.num1, x.den1, x.num2, x.den2) for x in metrics.precision_parts(table, ["i"], "h", F.col("r"), 2).collect()}
    assert found == {1: (2, 3, 0, 2), 2: (0, 1, 0, 1), 3: (2, 2, 1, 1)}
