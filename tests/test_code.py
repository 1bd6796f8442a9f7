"""Goldens and properties of the text and code functions."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.functions import code as C
from patchloom.functions import differences
from patchloom.functions import text as T
from patchloom.functions.similarity import jaro_winkler_score


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_padding():
    assert C.pad_code("foo(a,b);") == "foo ( a , b ) ;"
    assert C.pad_code('s = "a+b  (c)" + d') == 's = "a+b  (c)" + d'
    assert C.pad_code("i+=1;j++") == "i += 1 ; j ++"
    assert C.pad_code("List<>x") == "List < > x" and C.pad_code("") == "" and C.pad_code(None) is None


def test_comments():
    assert C.strip_comments('a; // x\n/* y\nz */\n"//kept" b') == 'a;  \n"//kept" b'.replace("  ", "  ")
    assert C.strip_comments(None) is None


def test_word_diff_and_edit_sequences():
    r = random.Random(1)
    vocab = ["a", "b", "c", "foo", "(", ")", ";"]
    for _ in range(400):
        a, b = (" ".join(r.choice(vocab) for _ in range(r.randint(1, 12))) for _ in range(2))
        ops = C.word_diff(a, b)
        assert "".join(t for o, t in ops if o <= 0) == a and "".join(t for o, t in ops if o >= 0) == b
        s = C.edit_sequence(a, b)
        assert C.apply_edit_sequence(a, s) == b or s == f"{C.OLD} {a} {C.NEW} {b} {C.END}"
    s = C.edit_sequence("int x = foo ( 1 ) ;", "int x = bar ( 1 ) ;")
    assert s == f"{C.OLD} foo {C.NEW} bar {C.END}"
    assert C.apply_edit_sequence("a a", f"{C.OLD} a {C.NEW} b {C.END}") is None
    assert C.apply_edit_sequence("a", "nothing") is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def test_scripts_are_shortest_and_rebuild_both_sides():
    r = random.Random(2)
    for case in range(1500):
        n = r.choice([0, 1, 2, 5, 12, 40])
        a, b = ([r.randrange(r.choice([2, 4, 30])) for _ in range(r.randint(0, n))] for _ in range(2))
        if case % 3 == 0:
            b = [x for x in a if r.random() < 0.8]
            b[len(b) // 2 : len(b) // 2] = a[: r.randint(0, 3)]
        pieces = differences.script(a, b)
        assert [x for op, t in pieces if op <= 0 for x in t] == a and [x for op, t in pieces if op >= 0 for x in t] == b
        assert sum(len(t) for op, t in pieces if op == 0) == lcs(a, b), (a, b)
        ops = [op for op, _ in pieces]
        assert all(x != y and (x, y) != (1, -1) for x, y in zip(ops, ops[1:])) and all(t for _, t in pieces)
        assert pieces == differences.script(a, b)


def test_long_lists():
    a = list(range(30_000))
    b = [x for x in a if x % 1000] + [-1]
    assert sum(len(t) for op, t in differences.script(a, b) if op) == 31
    r = random.Random(3)
    x, y = ([r.randrange(50) for _ in range(1500)] for _ in range(2))
    assert sum(len(t) for op, t in differences.script(x, y) if op == 0) == lcs(x, y)


def test_ways_to_a_meeting_point_agree():
    import numpy as np

    r = random.Random(4)
    code = lambda t: np.array([ord(c) for c in t], np.int64)
    for _ in range(400):
        vocab, n = r.choice(["ab", "abc", "abcdefghijklmnopqrst"]), r.choice([2, 6, 20, 45])
        a, b = ("".join(r.choice(vocab) for _ in range(r.randint(1, n))) for _ in range(2))
        wide = differences._stepwise_wide(code(a), code(b))
        assert differences._stepwise(a, b, (len(a) + len(b) + 1) // 2) == wide, (a, b)
        assert differences._from_table(a, b) == (wide if set(a) & set(b) else None), (a, b)
        pieces = differences.script(a, b)
        assert differences.counts(a, b) == tuple(sum(len(t) for op, t in pieces if op == kind) for kind in (-1, 0, 1)), (a, b)


def test_scripts_of_different_texts_are_quick():
    import time

    r = random.Random(6)
    pairs = [[[r.randrange(60) for _ in range(90)] for _ in range(2)] for _ in range(150)]
    start = time.process_time()
    for a, b in pairs:
        differences.script(a, b)
    assert time.process_time() - start < 2.5


def test_counts_of_words_count_blanks_alone():
    assert C.word_counts("a  b", "a b") == {"deleted": 1, "kept": 2, "inserted": 0} and C.word_counts(None, "x") == {"deleted": 0, "kept": 0, "inserted": 1}


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("a b c", "a x c", [(0, "a "), (-1, "b "), (1, "x "), (0, "c")]),
        ("a b", "a b c", [(0, "a "), (-1, "b"), (1, "b c")]),  # the last word has no blank after it
        ("", "x", [(1, "x")]),
        ("x y", "", [(-1, "x y")]),
        ("a b", "a b", [(0, "a b")]),
        ("a  b", "a b", [(0, "a "), (0, "b")]),  # a blank alone is no piece
        ("f ( a ) ;", "f ( a , b ) ;", [(0, "f ( a "), (1, ", b "), (0, ") ;")]),
        ("x a b", "x a b a b", [(0, "x a "), (1, "b a "), (0, "b")]),
        ("p q r s", "q r t s", [(-1, "p "), (0, "q r "), (1, "t "), (0, "s")]),
        (None, None, []),
    ],
)
def test_word_diff_goldens(a, b, want):
    assert C.word_diff(a, b) == want


def test_line_hunks():
    got = C.line_hunks("a\nb\nc", "a\nx\nc\nd")
    assert [(h["type"], [x["line"] for x in h["sourceChanges"]], [x["line"] for x in h["targetChanges"]]) for h in got] == [("MODIFY", ["b"], ["x"]), ("ADD", [], ["d"])]
    assert C.line_hunks(None, "x")[0]["type"] == "ADD" and C.line_hunks("x", "")[0]["type"] == "DELETE" and C.line_hunks("\n", "") == []


def test_column_functions(spark):
    assert one(spark, T.short_hash(F.lit("a"))) == "ca978112"
    flags = [one(spark, T.is_comment(F.lit(x))) for x in ("  // x", "/* x", " * x", "x */", "x // y")]
    assert flags == [True, True, True, True, False]
    p = one(spark, T.name_parts(F.lit("p.q.C.m(int)")))
    assert (p.class_full, p["class"], p.method) == ("p.q.C", "C", "m")
    change = lambda *n: F.array(*[F.struct(F.lit("x").alias("line"), F.lit(i).alias("lineNo")) for i in n])
    assert one(spark, T.hunk_location(change(12, 13), F.lit(None).cast("array<struct<line: string, lineNo: int>>"))) == "(12:null)"
    assert one(spark, T.hunk_text(F.array(F.lit("a")), F.array(F.lit("b")))) == "- a + b"
    assert one(spark, T.base_document(F.array(F.lit("x")), F.array(F.lit("y")))) == "[<HUNK>][<DEL>]x[<ADD>]y[</HUNK>]"
    assert [one(spark, T.normal_version(F.lit(v))) for v in ("1.8", "11", "x")] == [8, 11, None]


def test_greedy_skips_what_does_not_fit(spark):
    from patchloom.operators.ranking import greedy_select

    assert one(spark, greedy_select(F.array(*map(F.lit, (5, 7, 3, 2))), F.lit(10))) == [0, 2, 3]
    assert one(spark, greedy_select(F.array().cast("array<int>"), F.lit(10))) == []


def test_jaro_winkler():
    assert jaro_winkler_score("martha", "marhta") == pytest.approx(0.9611111)
    assert jaro_winkler_score("", "") == 1.0 and jaro_winkler_score("a", "") == 0.0 and jaro_winkler_score(None, "a") is None


H1 = "It is a guide to action which ensures that the military always obeys the commands of the party"
R1 = "It is a guide to action that ensures that the military will forever heed Party commands"


def test_bleu_golden(spark):
    from patchloom.operators import metrics

    pairs = spark.createDataFrame([(1, H1.split(), R1.split()), (2, ["x"], ["y"]), (3, [], ["y"])], "id int, h array<string>, r array<string>")
    got = {r.id: r.bleu for r in metrics.sentence_bleu(pairs, ["id"], "h", "r").collect()}
    assert got[1] == pytest.approx(0.41180376356915777) and got[2] == 0 and got[3] == 0
    assert one(spark, metrics.brevity(F.lit(28), F.lit(12))) == pytest.approx(0.2635971381157267)
    assert one(spark, metrics.closest_length(F.array(F.lit(13), F.lit(11)), F.lit(12))) == 11


def test_verdicts(spark):
    from patchloom.operators.verdicts import classify_logs

    passed = "Tests run: 1, Failures: 0, Errors: 0, Skipped: 0, Time elapsed: 0.1 s"
    rows = [
        (passed, 0, "success", None), ("x", 0, "test_not_executed", None), ("Tests run: 1, Failures: 0, Errors: 0, Skipped: 0", 0, "test_not_executed", None), ("", 124, "timeout", None),
        ("COMPILATION ERROR\n[ERROR] /a/src/T.java:[7,1] x\n[ERROR] /a/src/T.java:[3,2] y", 1, "compile_error", [3, 7]), ("COMPILATION ERROR\n[ERROR] /a/src/Other.java:[7,1] x", 1, "unrelated_compile_error", None),
        ("\tat a.T.m(T.java:12)", 1, "failure", [12]), ("\tat a.T.other(T.java:12)", 1, "unknown", None), ("[ERROR]   T.m:9 wanted", 1, "failure", [9]), ("[ERROR]   T.mm:9 wanted", 1, "unknown", None),
        ("Tests run: 2, Failures: 0, Errors: 1, Skipped: 0, Time elapsed: 1 s", 1, "failure", []), ("Tests run: 2, Failures: 0, Errors: 0, Skipped: 1, Time elapsed: 1 s", 1, "test_not_executed", None),
        ("Could not resolve dependencies", 1, "dependency_error", None), ("?", 1, "unknown", None), (None, 1, "unknown", None),
    ]
    frame = spark.createDataFrame([(*r, "T", "m", "src/T.java") for r in rows], "log string, code int, want string, at array<int>, c string, m string, p string")
    for r in classify_logs(frame, "log", "code", "c", "m", "p").collect():
        assert (r.status, r.error_lines) == (r.want, r.at), r.log


def test_literals_and_comments():
    assert C.pad_code('f("a\tb",1)') == 'f ( "a\tb" , 1 )' and C.pad_code("it's\nfoo(a);\nisn't") == "it's foo ( a ) ; isn't"
    assert C.pad_code("\ue000+1") == "\ue000 + 1"
    assert C.strip_comments("char c = '\\''; // d") == "char c = '\\'';  "


def test_range_nearest(spark):
    from patchloom.operators.joins import range_nearest

    left = spark.createDataFrame([(x,) for x in (1, 5, 17, 40, 95, 200)], "v int")
    right = spark.createDataFrame([(x,) for x in (3, 17, 60, 99)], "c int")
    got = {r.v: r.n for r in range_nearest(left, "v", right, "c", -1, "n", 10.0).collect()}
    assert got == {1: 3, 5: 17, 17: 17, 40: 60, 95: 99, 200: -1}


def test_a_batch_is_read_one_row_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"{i} " + "x" * 20_000 for i in range(2_000)])
    run = C._arrow(lambda a, b: a[:3] + b[:3], "string")
    tracemalloc.start()
    done = run(texts, texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done.to_pylist() == [f"{i} xx"[:3] * 2 for i in range(2_000)] and run(texts[:0], texts[:0]).to_pylist() == []
    assert most < 4 << 20
