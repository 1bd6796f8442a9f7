"""Table functions for lateral joins: one input row gives the rows of its hunks, edits or words, without nested columns.

``register`` names them for SQL: ``SELECT ... FROM t, LATERAL hunk_lines(t.before, t.after)``. All are pure, so a repeated task gives the
same rows, and every row's output is yielded as it is found.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from patchloom.functions.code import line_hunks, word_diff
from patchloom.functions.edits import parse


class HunkLines:
    """A row for each deleted and added line of the hunks between two texts, in order; nulls are empty texts."""

    def eval(self, before: str, after: str) -> Iterator[tuple]:
        for number, hunk in enumerate(line_hunks(before, after)):
            for line in hunk["sourceChanges"] + hunk["targetChanges"]:
                yield number, hunk["type"], line["type"], line["lineNo"], line["line"]


class WordEdits:
    """A row for each run of deleted (-1), kept (0) and inserted (1) words between two texts, in order."""

    def eval(self, before: str, after: str) -> Iterator[tuple]:
        for place, (op, text) in enumerate(word_diff(before, after)):
            yield place, op, text


class EditBlocks:
    """A row for each block of an edit sequence: its place, form, old and new text; none for null or what is no sequence."""

    def eval(self, sequence: str) -> Iterator[tuple]:
        for place, block in enumerate(parse(sequence or "") or []):
            yield place, *block


#: Name, class and columns of each function.
TABLES = (
    ("hunk_lines", HunkLines, "hunk_no int, hunk_type string, line_type string, line_no int, line string"),
    ("word_edits", WordEdits, "place int, op int, text string"),
    ("edit_blocks", EditBlocks, "place int, form string, old string, new string"),
)


def register(spark: SparkSession) -> None:
    """Make the table functions callable from SQL in this session (rows travel in Arrow batches)."""
    for name, kind, columns in TABLES:
        spark.udtf.register(name, F.udtf(kind, returnType=columns, useArrow=True))
