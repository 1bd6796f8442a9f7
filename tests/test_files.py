"""Readers, writers, history and streams on small files."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from patchloom.sources import git, readers
from patchloom.streaming import verdicts as stream


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


def test_change_sets_and_graphs_need_one_file(spark, tmp_path):
    sets = [{"bCommit": "b", "aCommit": "a", "changes": []}]
    graph = {"c1": {"t1": {"root": {"id": 0, "name": "t1", "path": "p", "depth": 0}, "nodes": [], "graph": {}}}}
    for project in ("org/one", "org/two"):
        put(tmp_path, f"{project}/sut_class_changes.json", sets)
        put(tmp_path, f"{project}/call_graphs.json", graph)
    put(tmp_path, "x/org/two/sut_class_changes.json", sets)
    put(tmp_path, "x/org/two/call_graphs.json", graph)
    assert [r.project for r in readers.read_change_sets(spark, str(tmp_path)).collect()] == ["org/one"]
    assert [(r.project, r.commit, r.test) for r in readers.read_call_graphs(spark, str(tmp_path)).collect()] == [("org/one", "c1", "t1")]


def test_verdict_files(spark, tmp_path):
    put(tmp_path, "v/0.json", [{"verdict": {"status": "success"}, "id": "0", "rank": 0}, {"verdict": {"status": "failure", "error_lines": [3]}, "id": "0", "rank": 1}])
    put(tmp_path, "v/1.json", "")
    put(tmp_path, "v/3.json", [{"verdict": {"status": "timeout"}, "id": "3", "rank": 0}])
    rows, counts = readers.read_verdicts(spark, str(tmp_path / "v"))
    assert tuple(counts.first()) == (3, 1)
    assert sorted(r.id for r in rows.collect()) == ["0", "0", "3"]
    assert sorted(r.ind for r in readers.missing_verdicts(rows, 4).collect()) == [1, 2]


def test_logs_elements_renames(spark, tmp_path):
    put(tmp_path, "logs/a/test.log", "1\nmvn test\nJAVA_HOME=/jdk/11\nline one\nline two")
    got = readers.read_logs(spark, str(tmp_path / "logs")).first()
    assert (got.code, got.command, got.java_home, got.log) == (1, "mvn test", "/jdk/11", "line one\nline two")
    put(tmp_path, "e.json", {"c": {"t": {"types": ["A", "B"], "executables": ["A", "m"]}}})
    assert sorted(r.element for r in readers.read_elements(spark, str(tmp_path / "e.json")).collect()) == ["A", "B", "m"]
    put(tmp_path, "r.json", {"c": [{"refactoringType": "Rename Method", "originalName": "a", "newName": "b"}]})
    assert tuple(readers.read_renames(spark, str(tmp_path / "r.json")).first()) == ("c", "Rename Method", "a", "b")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'say "hi", now\nthen', 2), ("2", None, 3)], "ID string, text string, n int")
    readers.write_csv(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "c"), "ID string, text string, n int").collect())) == sorted(map(tuple, rows.collect()))
    readers.write_array(rows, str(tmp_path / "a.json"))
    assert [x["ID"] for x in json.loads((tmp_path / "a.json").read_text())] == ["1", "2"]
    with pytest.raises(ValueError):
        readers.write_array(rows, str(tmp_path / "b.json"), rows=1)
    put(tmp_path, "p.json", [{"ID": "1", "target": "t", "preds": ["a", "t"]}])
    assert readers.read_predictions(spark, str(tmp_path / "p.json")).first().preds == ["a", "t"]
    readers.write_texts(rows.select(F.concat(F.lit("d/"), "ID", F.lit(".txt")).alias("name"), "text"), f"file://{tmp_path}/t", "name", "text")
    assert (tmp_path / "t/d/1.txt").read_text() == 'say "hi", now\nthen' and (tmp_path / "t/d/2.txt").read_text() == ""
    rows.write.parquet(str(tmp_path / "table"))
    marked = readers.annotate(spark.read.parquet(str(tmp_path / "table")).withColumn("more", F.lit(1)), str(tmp_path / "table"), "v2")
    assert marked.count() == 2 and "more" not in spark.read.parquet(str(tmp_path / "table")).columns


def test_stages_are_computed_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.stage(make, spark, str(tmp_path / "s")).count() == 3
    assert len(calls) == 1


def test_git_history(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    put(tmp_path, "A.java", "class A {\n  int x = 1;\n  int y = 2;\n  int z = 3;\n}\n")
    put(tmp_path, "b.txt", "text")
    run("add", "."), run("commit", "-qm", "one")
    put(tmp_path, "A.java", "class A {\n  int x = 5;\n  int y = 2;\n  int z = 3;\n}\n")
    run("commit", "-qam", "two")
    run("checkout", "-qb", "side", "HEAD~1")
    run("mv", "A.java", "B.java"), run("commit", "-qm", "moved")
    run("checkout", "-q", "main"), run("merge", "-q", "--no-ff", "-m", "merged", "side")
    commits = git.read_commits(spark, str(tmp_path), commits_per_task="2").collect()
    assert len(commits) == 3 and all(r.sha.startswith(r.short_sha) and r.n_parents <= 1 for r in commits)
    changes = git.read_changes(spark, str(tmp_path)).collect()
    assert sorted((r.status, r.before_path, r.after_path) for r in changes) == [("M", "A.java", "A.java"), ("R", "A.java", "B.java")]
    changed = next(r for r in changes if r.status == "M")
    assert "x = 1" in changed.before and "x = 5" in changed.after
    only = git.changes_of(git.read_changes(spark, str(tmp_path)), spark.createDataFrame([(changed.sha,)], "aCommit string"))
    assert [r.status for r in only.collect()] == ["M"]


def test_verdict_stream(spark, tmp_path):
    put(tmp_path, "in/0.json", [{"verdict": {"status": "failure"}, "id": "0", "rank": 0}])
    rates = stream.running_success(stream.read_verdicts(spark, str(tmp_path / "in")))

    def go():
        query = rates.writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return {r.id: (r.n, r.ok) for r in spark.table("rates").collect()}

    assert go() == {"0": (1, False)}
    put(tmp_path, "in/1.json", [{"verdict": {"status": "success"}, "id": "0", "rank": 1}, {"verdict": {"status": "timeout"}, "id": "7", "rank": 0}])
    put(tmp_path, "in/2.json", "")
    assert go() == {"0": (2, True), "7": (1, False)}


def test_latest_row_stream(spark, tmp_path):
    schema = "k string, t long, o long, p string"
    put(tmp_path, "in/a.json", "\n".join(json.dumps(dict(zip("ktop", r))) for r in [("x", 5, 2, "five"), ("x", 5, 1, "earlier"), ("y", 1, 1, "one")]))
    put(tmp_path, "in/b.json", "\n".join(json.dumps(dict(zip("ktop", r))) for r in [("x", 4, 0, "old"), ("y", 2, 9, "two")]))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream.keep_latest(source, "k", "t", "o", "p").writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = [tuple(r) for r in spark.table("latest").collect()]
    assert ("x", 5, 1, "earlier") in rows and ("y", 2, 9, "two") in rows and rows[-1][3] != "old"


def test_windowed_verdicts(spark, tmp_path):
    rows = [{"ts": "2024-01-01T00:10:00", "verdict": {"status": "success"}}, {"ts": "2024-01-01T00:50:00", "verdict": {"status": "success"}}, {"ts": "2024-01-01T05:00:00", "verdict": {"status": "timeout"}}]
    put(tmp_path, "in/a.json", "\n".join(map(json.dumps, rows)))
    source = spark.readStream.schema("ts timestamp, verdict struct<status: string>").json(str(tmp_path / "in"))
    query = stream.windowed_verdicts(source, "ts").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.status, r.n) for r in spark.table("windows").collect()] == [("success", 2)]
