"""A repository's history as a stream: restarts, merges, and the rows of a batch read."""

import subprocess

from patchloom.sources import git


def run(folder, *args):
    return subprocess.run(["git", "-C", str(folder), "-c", "user.name=a", "-c", "user.email=a@b.c", *args], check=True, capture_output=True, text=True).stdout


def commit(folder, name, text):
    (folder / name).write_text(text)
    run(folder, "add", "-A")
    run(folder, "commit", "-qm", name)


def drain(frame, folder, name):
    query = frame.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_only_new_commits_are_read_after_a_restart(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run(repo, "init", "-q", "-b", "main")
    for i in range(3):
        commit(repo, "A.java", f"class A {{ int a = {i}; }}\n")
    rows = lambda: sorted(r.sha for r in spark.read.parquet(f"{tmp_path}/out").collect())
    drain(git.stream_commits(spark, str(repo), commits_per_task="2"), tmp_path, "out")
    first = rows()
    assert first == sorted(r.sha for r in git.read_commits(spark, str(repo)).collect()) and len(first) == 3
    drain(git.stream_commits(spark, str(repo)), tmp_path, "out")
    assert rows() == first  # nothing new
    run(repo, "checkout", "-qb", "side", "HEAD~1")
    commit(repo, "B.java", "class B {}\n")
    run(repo, "checkout", "-q", "main")
    commit(repo, "A.java", "class A { }\n")
    run(repo, "merge", "-q", "--no-ff", "-m", "merge", "side")
    drain(git.stream_commits(spark, str(repo)), tmp_path, "out")
    assert rows() == sorted(r.sha for r in git.read_commits(spark, str(repo)).collect()) and len(rows()) == 5


def test_changes_and_offsets(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run(repo, "init", "-q", "-b", "main")
    for i in range(4):
        commit(repo, "A.java", f"class A {{ int a = {i}; }}\n")
    reader = git.GitStreamReader({"repo": str(repo), "commits_per_task": "3"})
    start, middle = reader.initialOffset(), reader.latestOffset()
    assert [len(p.lines) for p in reader.partitions(start, middle)] == [3, 1] and reader.partitions(middle, middle) == []
    drain(git.stream_changes(spark, str(repo)), tmp_path, "changes")
    for i in range(4, 7):
        commit(repo, "A.java", f"class A {{ int a = {i}; }}\n")
    assert sum(len(p.lines) for p in reader.partitions(middle, reader.latestOffset())) == 3
    drain(git.stream_changes(spark, str(repo)), tmp_path, "changes")
    got = sorted((r.sha, r.before, r.after) for r in spark.read.parquet(f"{tmp_path}/changes").collect())
    assert got == sorted((r.sha, r.before, r.after) for r in git.read_changes(spark, str(repo)).collect()) and len(got) == 6
