"""A repository's history as tables: a Python data source over the ``git`` command.

``spark.dataSource.register(GitDataSource)``, then ``spark.read.format("git").option("repo", path)`` with
``table`` = ``commits`` (sha, short_sha, time, n_parents) or ``changes`` (sha, parent, status, before_path,
after_path, before, after). The driver lists the commits that ``revision`` (default HEAD) reaches, once each; the
list is cut into ranges of ``commits_per_task``, which tasks read on their own. A change is told from the parent's
side: its earlier path and text, then the commit's. Commits of several parents are in ``commits``; ``changes``
leaves them out. The repository must be at the same path on every machine.

As a stream (:func:`stream_commits`, :func:`stream_changes`) the offset is the commit that ``revision`` names: a batch has what the
new one reaches and the old one does not, so a restart from a checkpoint reads only what came since. A history that was rewritten brings the commits that are new in it; none is taken back.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMAS = {
    "commits": "sha string, short_sha string, time long, n_parents int",
    "changes": "sha string, parent string, status string, before_path string, after_path string, before string, after string",
}


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", repo, *args], capture_output=True, check=True, timeout=600)
    return done.stdout.decode("utf-8", "replace")


class Commits(InputPartition):
    def __init__(self, lines: list[str]):
        self.lines = lines


class CommitRows:
    """What batch and stream share: the rows of a range of commits."""

    def __init__(self, options):
        self.repo, self.table = options["repo"], options.get("table", "commits")
        self.revision, self.step = options.get("revision", "HEAD"), int(options.get("commits_per_task", "200"))

    def ranges(self, *revisions: str) -> list[Commits]:
        lines = _git(self.repo, "log", "--format=%H %h %ct %P", *revisions).splitlines()
        return [Commits(lines[i : i + self.step]) for i in range(0, len(lines), self.step)]

    def read(self, partition):
        for line in partition.lines if partition else ():
            sha, short, time, *parents = line.split()
            if self.table == "commits":
                yield sha, short, int(time), len(parents)
            elif len(parents) == 1:
                yield from self._changes(sha, parents[0])

    def _changes(self, sha: str, parent: str):
        fields = iter(_git(self.repo, "diff", "--name-status", "-z", "-M", parent, sha).split("\0"))
        for status in fields:
            if not status:
                break
            kind, path = status[0], next(fields)
            later = next(fields) if kind in "RC" else path
            yield sha, parent, kind, None if kind == "A" else path, None if kind == "D" else later, self._text(parent, path, kind != "A"), self._text(sha, later, kind != "D")

    def _text(self, sha: str, path: str, there: bool) -> str | None:
        return _git(self.repo, "show", f"{sha}:{path}") if there else None


class GitReader(CommitRows, DataSourceReader):
    def partitions(self):
        return self.ranges(self.revision)


class GitStreamReader(CommitRows, DataSourceStreamReader):
    """Offsets are ``{"commit": sha}``; the empty sha is before the first commit. A batch of any size is cut into ranges."""

    def initialOffset(self):
        return {"commit": ""}

    def latestOffset(self):
        return {"commit": _git(self.repo, "rev-parse", self.revision).strip()}

    def partitions(self, start, end):
        return self.ranges(end["commit"], *([f"^{start['commit']}"] if start["commit"] else [])) if start != end else []


class GitDataSource(DataSource):
    @classmethod
    def name(cls):
        return "git"

    def schema(self):
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema):
        return GitReader(self.options)

    def streamReader(self, schema):
        return GitStreamReader(self.options)


def read_commits(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """Commits that are no merges, each once."""
    spark.dataSource.register(GitDataSource)
    return spark.read.format("git").options(repo=repo, table="commits", **options).load().where("n_parents <= 1").dropDuplicates(["sha"])


def read_changes(spark: SparkSession, repo: str, kinds: tuple[str, ...] = ("M", "R"), suffix: str = ".java", **options: str) -> DataFrame:
    """File changes of the given kinds whose paths on both sides (where there is one) end in ``suffix``."""
    spark.dataSource.register(GitDataSource)
    rows = spark.read.format("git").options(repo=repo, table="changes", **options).load()
    named = lambda c: F.coalesce(F.endswith(F.col(c), F.lit(suffix)), F.lit(True))
    return rows.where(F.col("status").isin(*kinds) & named("before_path") & named("after_path"))


def _stream(spark: SparkSession, repo: str, table: str, options: dict) -> DataFrame:
    spark.dataSource.register(GitDataSource)
    return spark.readStream.format("git").options(repo=repo, table=table, **options).load()


def stream_commits(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """Commits that are no merges as they come."""
    return _stream(spark, repo, "commits", options).where("n_parents <= 1")


def stream_changes(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """File changes of such commits as they come."""
    return _stream(spark, repo, "changes", options)


def changes_of(changes: DataFrame, repairs: DataFrame) -> DataFrame:
    """The changes of the commits that ``repairs`` (aCommit) end in."""
    return changes.join(repairs.select(F.col("aCommit").alias("sha")).distinct(), "sha", "left_semi")
