"""Nested fixtures: readers, categories, splits and encoders."""

import json

import pytest
from pyspark.sql import functions as F

from patchloom import schemas
from patchloom.operators import categorize, encoders, ranking
from patchloom.sources import readers


def repair(i, project_time, source, target, **more):
    lines = lambda xs, kind: [{"line": t, "type": kind, "lineNo": 11 + n} for n, t in enumerate(xs)]
    code = "void t() {\n" + "\n".join(source) + "\n// note\nend();\n}"
    base = {"ID": f"o/r:{i}", "name": "C.t()", "bCommit": f"b{i}", "aCommit": f"a{i}", "aCommitTime": project_time, "bSource": {"startLine": 10, "code": code}, "hunk": {"type": "MODIFY", "sourceChanges": lines(source, "DELETE"), "targetChanges": lines(target, "ADD")}}
    return base | more


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("bench")
    (root / "own/repo").mkdir(parents=True)
    rows = [repair(0, 5, ["a(1);"], ["a(2);"]), repair(1, 6, ["// only"], ["// comment"]), repair(2, 7, ["x;"], ["  x ;"]), repair(3, 8, ["b();"], []), repair(4, 9, ["far();"], ["near();"], trivial=["RENAME"])]
    rows[4]["hunk"]["sourceChanges"][0]["lineNo"] = 99
    (root / "own/repo/dataset.json").write_text(json.dumps(rows))
    change = lambda old, new: {"bPath": "P.java", "name": "m()", "is_test_source": False, "hunks": [{"sourceChanges": [{"line": old, "lineNo": 1}], "targetChanges": [{"line": new, "lineNo": 1}]}]}
    sets = [{"bCommit": f"b{i}", "aCommit": f"a{i}", "changes": [change("a(1);", "a(2);"), change("z;", "y;"), change("q;", " q ; ")]} for i in range(5)]
    (root / "own/repo/sut_class_changes.json").write_text(json.dumps(sets))
    return str(root)


@pytest.mark.parametrize("name", sorted(encoders.ENCODERS))
def test_encoders(spark, folder, name):
    repairs = readers.read_dataset(spark, folder)
    assert repairs.select("project").distinct().collect()[0].project == "own/repo"
    changes = readers.read_change_sets(spark, folder)
    got = {r.ID: r for r in encoders.encode(repairs, changes, name).collect()}
    assert set(got) == {"o/r:0", "o/r:3"}  # comments, blanks and lines outside the test are left out
    assert f"{encoders.BREAK_START}a ( 1 ) ;{encoders.BREAK_END}end" in got["o/r:0"].input and "note" not in got["o/r:0"].input
    if name == "EditSequence":
        assert got["o/r:0"].output.startswith("[<replaceOld>]")
    else:
        assert got["o/r:0"].output == "a ( 2 ) ;" and got["o/r:3"].output == encoders.DELETED
    assert got["o/r:0"].n_documents == (0 if name == "NoContext" else 2)


def test_missing_file_is_an_error(spark, folder):
    with pytest.raises(ValueError):
        readers.read_json(spark, folder, schemas.REPAIR, "none.json")


def test_nested_maps(spark, tmp_path):
    graph = {"c1": {"T.a()": {"root": {"id": 0, "name": "T.a()", "path": "T", "depth": 0}, "nodes": [{"id": 0, "name": "T.a()", "path": "T", "depth": 0}, {"id": 1, "name": "m()", "path": "P", "depth": 2}], "graph": {"0": [1]}}}}
    (tmp_path / "own/repo").mkdir(parents=True)
    (tmp_path / "own/repo/call_graphs.json").write_text(json.dumps(graph))
    graphs = readers.read_call_graphs(spark, str(tmp_path))
    got = {(r.key, r.depth, r.most) for r in encoders.node_depths(graphs).collect()}
    assert got == {("T.a()", 0, 2), ("T", 0, 2), ("m()", 2, 2), ("P", 2, 2)}


def action(kind, node, parent, src=None, dst=None):
    label = lambda x: None if x is None else (x, 0)
    return (kind, node, [parent], label(src), label(dst))


def test_categories(spark):
    plain = ("MODIFY", [("assertEquals(1, old)", "DELETE", 1)], [("assertEquals(1, fresh)", "ADD", 1)], None, None)
    rows = [
        ("1", plain, [action("Insert", "Literal", "Invocation", "9")]), ("2", plain, [action("Update", "Literal", "Invocation", "old", "fresh")]),
        ("3", plain, [action("Update", "Invocation", "Method", "assertTrue", "assertEquals")]), ("4", plain, [action("Update", "ConstructorCall", "Method", "A(x)", "A(x,y)")]),
        ("5", plain, [action("Update", "ConstructorCall", "Method", "A(x)", "BException()")]), ("6", plain, [action("Insert", "THROWN", "Method", "E")]), ("7", plain, []), ("8", plain, [action("Nothing", "Known", "Here")]),
    ]
    frame = spark.createDataFrame(rows, f"ID string, hunk {schemas.HUNK}, astActions array<{schemas.ACTION}>")
    got = {r.ID: r.categories for r in categorize.categorise(frame).collect()}
    assert got == {"1": ["ARGUMENT"], "2": ["ORACLE"], "3": ["INVOCATION"], "4": ["ARGUMENT"], "5": ["INVOCATION", "ORACLE"], "6": ["ORACLE"], "7": ["OTHER"], "8": ["OTHER"]}


def test_split_is_a_partition(spark):
    rows = [(f"p{p}", t, f"c{t}", f"{p}-{t}-{i}") for p in range(3) for t in range(1 if p == 0 else 6) for i in range(4)]
    split = ranking.temporal_split(spark.createDataFrame(rows, "project string, t int, c string, id string"), "project", "t", "c", "id")
    got = [(r.project, r.split) for r in split.collect()]
    assert len(got) == len(rows) and {s for p, s in got if p == "p0"} == {"train"}
    assert [s for p, s in got if p == "p1"].count("valid") * 3 == [s for p, s in got if p == "p1"].count("test")


def test_global_rank(spark):
    frame = spark.range(100).select(F.col("id"), (F.col("id") % 2).alias("g"))
    got = {r.id: (r.rn, r.n) for r in ranking.global_rank(frame, "g", [F.col("id").desc()]).collect()}
    assert got == {i: ((98 + i % 2 - i) // 2, 50) for i in range(100)}


def test_stage_is_written_once(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert readers.stage(lambda: spark.range(3), spark, path).count() == 3
    assert readers.stage(lambda: spark.range(9), spark, path).count() == 3
    assert [r.ind for r in readers.missing_verdicts(spark.createDataFrame([("0",), ("2",)], "id string"), 3).collect()] == [1]


def test_repairs_hold_all_lines(spark, tmp_path):
    """Later lines reach the hunks, and turns that differ only there are changes."""
    from patchloom.plans import changes

    turns = [(1, 0, "user", "same\nold one\nkept\nold two"), (1, 1, "assistant", "same\nnew one\nkept\nnew two\nnew three"), (1, 2, "user", "other")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    repairs, sets, methods = changes.repairs(spark, str(tmp_path))
    lines = lambda side: [(x.line, x.lineNo) for x in side]
    hunk = repairs.where("ID = '1:0'").first().hunk
    assert lines(hunk.sourceChanges) == [("old one", 11), ("old two", 13)] and lines(hunk.targetChanges) == [("new one", 11), ("new two", 13), ("new three", 14)]
    first = sets.first().changes[0].hunks
    assert [(lines(h.sourceChanges), lines(h.targetChanges)) for h in first] == [([("old one", 11)], [("new one", 11)]), ([("old two", 13)], [("new two", 13), ("new three", 14)])]
    encoded = changes.encoders.encode(repairs, sets, "NoContext", methods=methods)
    assert {r.ID: r.output for r in encoded.collect()}["1:0"] == "new one new two new three"


def test_overlap_of_every_document(spark, tmp_path):
    """No document is left out for its id, and each meets every item."""
    from patchloom.plans.catalogue import QUERIES

    spark.createDataFrame([(1, "a a b"), (7, "b c"), (25, "z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a a a b"), (1, "c x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("multiset_overlap", "set_overlap")}
    assert got == {"multiset_overlap": {(1, 0, 3), (7, 0, 1), (7, 1, 1)}, "set_overlap": {(1, 0, 4), (7, 0, 1), (7, 1, 1)}}


def test_concat_document_of_whole_turns(spark, tmp_path):
    import hashlib

    from patchloom.plans.catalogue import QUERIES

    long, answer = "word " * 20 + "end", "answer " * 9 + "end"
    spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", answer)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["concat_document"](spark, str(tmp_path)).first().document
    assert got == hashlib.md5(f"[<HUNK>][<DEL>]{long}[<ADD>]{answer}[</HUNK>]".encode()).hexdigest()


def test_bfs_depth_over_all_line_items(spark, tmp_path):
    """Against a plain search; small quantities carry edges too."""
    from patchloom.plans.catalogue import QUERIES

    lines = [(1, 1, 50.0), (1, 2, 1.0), (2, 2, 3.0), (2, 3, 49.0), (3, 3, 2.0), (4, 9, 50.0)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    near, depths = {}, {"s1": 0}
    for s, p, _ in lines:
        near.setdefault(f"s{s}", set()).add(f"p{p}")
        near.setdefault(f"p{p}", set()).add(f"s{s}")
    for depth in (1, 2, 3):
        for node in [n for n, k in depths.items() if k == depth - 1]:
            for other in near[node]:
                depths.setdefault(other, depth)
    assert {r.node: r.depth for r in QUERIES["bfs_depth"](spark, str(tmp_path)).collect()} == depths


def test_edit_sequence_fallbacks_are_rare(spark, tmp_path):
    """Small edits of long texts need no whole replacement; a text that shares no word does."""
    from patchloom.plans.catalogue import QUERIES

    base = [f"w{i}" for i in range(30)]
    turns = [(1, t, "user", " ".join(w + "x" if i in (3 * t, 3 * t + 7) else w for i, w in enumerate(base))) for t in range(8)] + [(2, 0, "user", "a b"), (2, 1, "user", "c d")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in QUERIES["edit_sequence_fallbacks"](spark, str(tmp_path)).collect()}
    assert all(r.applied for r in got.values()) and {k for k, r in got.items() if r.whole} == {(2, 0)}
    assert got[2, 0].n_replacements == 1 and min(r.n_replacements for k, r in got.items() if k[0] == 1) > 1


def test_tfidf_of_word_arrays_is_that_of_words_with_one_exchange(spark):
    import random

    import pytest
    from pyspark.sql import functions as F

    from patchloom.operators import ranking

    r = random.Random(8)
    rows = [(f"g{g}", n, [r.choice("abcdefgh") for _ in range(r.choice([0, 1, 4, 9]))]) for g in range(12) for n in range(-1, 5) if n >= 0 or g % 5]
    docs = spark.createDataFrame(rows, "ID string, doc_no int, words array<string>")
    each = ranking.tfidf_cosine(docs.select("ID", "doc_no", F.explode("words").alias("token")), "ID", "doc_no", F.lit(-1))
    got = ranking.tfidf_cosine_of_words(docs, "ID", "doc_no", F.lit(-1), "words")
    want = {(x.ID, x.doc_no): x.similarity for x in each.collect()}
    assert {(x.ID, x.doc_no): x.similarity for x in got.collect()} == pytest.approx(want) and want
    assert got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("Exchange ") == 1


def test_a_category_expression_grows_with_the_patterns_only(spark):
    from pyspark.sql import functions as F

    made = categorize.action_categories(F.col("a"), F.col("s"), F.col("t"))
    assert len(made._jc.toString()) < 60_000
