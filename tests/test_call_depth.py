"""Call-graph depth in the ranking of documents, end to end; places of hunks beyond a number's room."""

import json

from pyspark.sql import functions as F

from patchloom.operators import encoders
from patchloom.sources import readers


def put(root, name, rows):
    path = root / "own/repo" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(rows))


def change(path, old, new):
    return {"bPath": path, "name": f"{path}.m()", "is_test_source": False, "hunks": [{"sourceChanges": [{"line": old, "lineNo": 1}], "targetChanges": [{"line": new, "lineNo": 1}]}]}


def test_nearer_classes_come_first(spark, tmp_path):
    hunk = {"type": "MODIFY", "sourceChanges": [{"line": "a(1);", "type": "DELETE", "lineNo": 11}], "targetChanges": [{"line": "a(2);", "type": "ADD", "lineNo": 11}]}
    own = {"ID": "o/r:0", "name": "C.t()", "bCommit": "b", "aCommit": "a", "aCommitTime": 1, "bSource": {"startLine": 10, "code": "void t() {\na(1);\n}"}, "hunk": hunk}
    put(tmp_path, "dataset.json", [own])
    put(tmp_path, "sut_class_changes.json", [{"bCommit": "b", "aCommit": "a", "changes": [change("Far", "f(1);", "f(2);"), change("Near", "n(1);", "n(2);"), change("Gone", "g(1);", "g(2);")]}])
    node = lambda i, path, depth: {"id": i, "name": f"{path}.x()", "path": path, "depth": depth}
    nodes = [node(0, "T", 0), node(1, "Far", 4), node(2, "Near", 1), node(3, "Near", 3), node(4, "Deep", 6)]
    put(tmp_path, "call_graphs.json", {"b": {"C.t()": {"root": nodes[0], "nodes": nodes, "graph": {"0": [1, 2, 3, 4]}}, "D.other()": {"root": nodes[0], "nodes": [node(0, "Gone", 0)], "graph": {}}}})
    repairs, changes = readers.read_dataset(spark, str(tmp_path)), readers.read_change_sets(spark, str(tmp_path))
    graphs = readers.read_call_graphs(spark, str(tmp_path))
    order = lambda row: [m for _, m in sorted((row.input.index(f"{x} ( 2"), x) for x in "fng")]
    # a class keeps its first node's depth; one that the test does not call has the graph's greatest depth; other tests do not count
    assert order(encoders.encode(repairs, changes, "Base", graphs=graphs).first()) == ["n", "f", "g"]
    assert order(encoders.encode(repairs, changes, "Base").first()) == ["f", "n", "g"]


def test_documents_keep_apart_beyond_a_hundred_thousand_hunks(spark):
    hunks = F.transform(F.sequence(F.lit(1), F.lit(100_002)), lambda i: F.struct(F.array(F.struct(F.concat(F.lit("x"), i).alias("line"), F.lit("DELETE").alias("type"), i.alias("lineNo"))).alias("sourceChanges"), F.array(F.struct(F.concat(F.lit("y"), i).alias("line"), F.lit("ADD").alias("type"), i.alias("lineNo"))).alias("targetChanges")))
    one = F.struct(F.lit("P").alias("bPath"), F.lit("m").alias("name"), F.lit(False).alias("is_test_source"), hunks.alias("hunks"))
    changes = spark.range(1).select(F.lit("p").alias("project"), F.lit("a").alias("aCommit"), F.array(one, one).alias("changes"))
    found = encoders.hunk_documents(changes, encoders.ENCODERS["Base"])
    assert found.select("doc_no").distinct().count() == 200_004
